"""Language identification, Merkle manifest and spelling variants against brute force on texts that hold the awkward cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorframe.llm import language_id, queries, spelling
from sensorframe.llm.language_id import WINDOW, ByteNetwork, fit_language_network, predict_language, windows_of
from sensorframe.llm.manifest import COLUMNS, folded, grow, merkle_manifest, row_digest, siblings
from sensorframe.llm.spelling import gram_prefix, near_words, pivots, spelling_groups

from test_operators import bag, corpus, prose

#: Columns of other tables that an operator must not trip over.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, rank long, digest string, word string, n long, carried string, body string, score double"
CLASH = ("t", 1, "d", "w", 2, "c", "b", 0.5)


def table(spark, rows):
    return spark.createDataFrame([(*r, *CLASH) for r in rows], SCHEMA)


def odd_rows():
    """Nulls in every column, empty and long texts, repeated rows and ids."""
    rows = [(r[0], r[1], r[2], r[3], None if i % 5 == 0 else len(r[1] or "")) for i, r in enumerate(corpus())]
    return rows + [(7, "same id", "en", "s", 1), (7, "same id", "en", "s", 1), (8, "zürich", "Ätna", None, 3), (9, "x", "", "s", 2)]


# --- manifest ---------------------------------------------------------------


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def slow_digest(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def slow_levels(digests):
    levels = [digests]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
    return levels


def slow_steps(levels, at):
    out = []
    for level in levels[:-1]:
        beside = level[at ^ 1] if at ^ 1 < len(level) else None
        out.append((beside, None) if at % 2 else (None, beside))
        at //= 2
    return out


def slow_manifest(rows):
    """(doc_id, leaf, subroot, root, steps) of rows (doc_id, text, lang, source, n_chars)."""
    groups = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        groups[lang].append((doc_id, slow_digest((doc_id, source, lang, n, text))))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = [slow_levels([leaf for _, leaf in groups[g]]) for g in order]
    top = slow_levels([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(order):
        for at, (doc_id, leaf) in enumerate(groups[g]):
            out.append((doc_id, leaf, trees[k][-1][0], top[-1][0], tuple(slow_steps(trees[k], at) + slow_steps(top, k))))
    return out


def got_manifest(docs):
    found = merkle_manifest(docs).withColumn("back", folded(F.col("leaf"), F.col("steps")))
    rows = found.collect()
    assert all(r.back == r.root for r in rows)
    return [(r.doc_id, r.leaf, r.subroot, r.root, tuple((s["left"], s["right"]) for s in r.steps)) for r in rows]


def test_manifest_of_odd_rows_equals_brute_force(spark):
    rows = odd_rows()
    assert bag(got_manifest(table(spark, rows).repartition(4))) == bag(slow_manifest(rows))


@pytest.mark.parametrize("sizes", [(1,), (2,), (3, 1), (63, 64, 65), (127, 130), (4096,), (4097, 5)])
def test_manifest_of_trees_around_the_width_of_a_bucket(spark, sizes):
    rows = [(1000 * g + i, None, f"l{g}", "s", i) for g, size in enumerate(sizes) for i in range(size)]
    assert bag(got_manifest(table(spark, rows))) == bag(slow_manifest(rows))


def test_manifest_of_an_empty_table(spark):
    assert merkle_manifest(table(spark, [])).collect() == []


def test_nodes_carry_the_intervals_of_their_leaves(spark):
    n = 150
    leaves = spark.range(n).select(F.lit("=x").alias("tree"), F.col("id").alias("rank"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    nodes = grow(leaves, "nodes").nodes().collect()
    levels = slow_levels([sha(str(i)) for i in range(n)])
    want = Counter()
    for k, level in enumerate(levels):
        for i, digest in enumerate(level):
            up = (i // 2 * 2 << k, min((i // 2 + 1) * 2 << k, n)) if k + 1 < len(levels) else (None, None)
            want[(k if up[0] is not None else None, i << k, min((i + 1) << k, n), digest, *up)] += 1
    assert Counter((r.level, r.lo, r.hi, r.digest, r.plo, r.phi) for r in nodes) == want


def test_a_changed_row_does_not_lead_to_the_root(spark):
    rows = [(i, prose(i, 5), "en", "s", i) for i in range(20)]
    changed = row_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS])
    found = merkle_manifest(table(spark, rows), carry=[changed.alias("changed")])
    wrong = found.where(folded(F.col("changed"), F.col("steps")) == F.col("root"))
    assert wrong.count() == 0 and found.where(F.size(siblings(F.col("steps"))) > 0).count() == 20


# --- spelling ---------------------------------------------------------------


def slow_words(rows):
    total = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            total[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 31 == 0 else word] += 1
    return {w: n for w, n in total.items() if len(w) >= 7 and n >= 2}


def one_apart(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_groups(words):
    near = {w: [v for v in words if one_apart(w, v)] for w in words}

    def form(w):
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        return best if best is not None and words[best] >= 10 * words[w] else None

    def root(w):
        while form(w):
            w = form(w)
        return w

    return {(w, form(w), root(w), n, len(near[w]), words[form(w)] if form(w) else None) for w, n in words.items()}


def misspelt(seed, word):
    rng = random.Random(seed)
    at, letter = rng.randrange(len(word)), rng.choice("abcäéÿÀ")
    return rng.choice([word[:at] + word[at + 1 :], word[:at] + letter + word[at:], word[:at] + letter + word[at + 1 :]])


def spelling_rows():
    """Words and their misspellings, chains of forms, repeated letters, × and ÷, upper case, nulls, a hot word and a long text."""
    rng = random.Random(5)
    base = ["morning", "sunlight", "naïvetés", "évolution", "aaaaaaaa", "abababab", "Überblick", "ÀÉÎÕÜÿß", "×÷×÷×÷×", "wolfstone"]
    words = [(w, 400 if i < 2 else 60) for i, w in enumerate(base)]
    words += [(misspelt(s, base[s % len(base)]), 1 + s % 7) for s in range(200)]
    words += [("aaaaaaa", 3), ("aaaaaaaaa", 2), ("abababa", 2), ("bababab", 5), ("bababab" + "a", 90), ("wolfston", 6), ("wolfsto", 5), ("olfston", 2), ("mornings", 36), ("morningsx", 3)]
    bag_of = [w if rng.random() < 0.7 else w.upper() for w, n in words for _ in range(n)]
    rng.shuffle(bag_of)
    texts = [" ".join(bag_of[i : i + 40]) for i in range(0, len(bag_of), 40)]
    return [(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (None, texts[0]), (None, texts[0]), (3, texts[3]), (902, "-".join(bag_of) * 2)]


def test_spelling_groups_equal_brute_force(spark):
    rows = [(i, t, None, None, None) for i, t in spelling_rows()]
    got = {tuple(r) for r in spelling_groups(table(spark, rows).repartition(6)).collect()}
    want = slow_groups(slow_words(spelling_rows()))
    assert got == want
    assert any(r[1] and r[1] != r[2] for r in want) and any(r[4] > 5 for r in want)


def test_near_words_of_random_words_equal_brute_force(spark):
    rng = random.Random(2)
    words = {"".join(rng.choice("abé") for _ in range(rng.randint(7, 11))) for _ in range(500)}
    words |= {misspelt(i, w) for i, w in enumerate(sorted(words)) if len(w) > 7}
    found = near_words(spark.createDataFrame([(w, 2) for w in sorted(words)], "word string, n long")).collect()
    assert Counter((r.a, r.b) for r in found) == Counter((a, b) for a in words for b in words if a < b and one_apart(a, b))


def test_pivots_are_the_rarest_that_do_not_overlap():
    rng = random.Random(4)
    for _ in range(300):
        word = "".join(rng.choice("abcd") for _ in range(rng.randint(7, 12)))
        seen = {a + b: rng.randint(1, 50) for a in "abcd" for b in "abcd"}
        rank = {g: k for k, g in enumerate(sorted(seen, key=lambda g: (seen[g], g)))}
        prefix, last = gram_prefix(word, rank)
        assert len(prefix) >= 3 and all((rank[word[i : i + 2]] <= last) == (i in prefix) for i in range(len(word) - 1))
        cost = lambda a, b: seen[word[a : a + 2]] + seen[word[b : b + 2]]
        a, b = pivots(word, prefix, seen)
        assert b - a >= 2 and cost(a, b) == min(cost(x, y) for x in prefix for y in prefix if y - x >= 2)


def test_words_are_counted_alike_however_often_they_are_passed_on(spark, monkeypatch):
    rows = [(i, t, None, None, None) for i, t in spelling_rows()]
    monkeypatch.setattr(spelling, "COUNTED_WORDS", 3)
    assert {r.word: r.n for r in spelling.count_words(table(spark, rows)).collect()} == slow_words(spelling_rows())


def test_spelling_of_tables_without_words(spark):
    for rows in ([], [(1, None, None, None, None), (2, "short words only", None, None, None)]):
        assert spelling_groups(table(spark, rows)).collect() == []


# --- languages --------------------------------------------------------------

TONGUES = {"aa": "kaluma nepo sidu rakato", "bb": "strzch wrbsk plnmt grdfv", "çç": "éàùê öüäß œæø îôû"}


def speech(lang, seed, n):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(TONGUES[lang].split()) for _ in range(n))


def test_windows_hold_every_byte_once():
    rng = random.Random(1)
    texts = [bytes(rng.randrange(97, 123) for _ in range(n)) for n in (1, 3, 252, 253, 255, 256, 257, 512, 1000, 5000)] + ["É Zürich".encode()]
    rows, owner, inside = windows_of(texts)
    for i, text in enumerate(texts):
        own = rows[owner == i]
        assert b"".join(bytes(r[:WINDOW]) for r in own)[: len(text)] == text.lower()
        assert inside[owner == i].sum() == len(text) and own.shape[1] == WINDOW + 4
        assert all(bytes(a[WINDOW:]) == bytes(b[:4]) for a, b in zip(own, own[1:]))


def test_log_odds_equal_a_plain_convolution():
    net = ByteNetwork.fresh(["x", "y", "z"], seed=3)
    net.bias += 0.1
    rows, _, _ = windows_of([b"some bytes " * 40, "größe".encode()])
    got = net.log_odds(rows)
    for row, own in zip(rows, got):
        hidden = []
        for f in range(net.filters.shape[1]):
            width = language_id.WIDTHS[f // language_id.FILTERS]
            w = net.filters[:, f].reshape(-1, language_id.EMBED)
            assert not w[width:].any()
            best = max(sum(float(net.embed[row[p + k]] @ w[k]) for k in range(width)) for p in range(WINDOW))
            hidden.append(max(best + float(net.bias[f]), 0.0))
        logits = np.array(hidden) @ net.weight + net.offset
        assert np.allclose(own, logits - np.log(np.exp(logits).sum()), atol=1e-4)


def test_gradients_equal_differences():
    net = ByteNetwork.fresh(["x", "y"], seed=1)
    weights = ["embed", "filters", "bias", "weight", "offset"]
    for name in weights:
        setattr(net, name, getattr(net, name).astype(np.float64))
    rows, _, _ = windows_of([b"abc defg " * 9, b"zyx wvut " * 9, b"hello"])
    label = np.array([0, 1, 1])
    loss = lambda: -net.log_odds(rows)[np.arange(3), label].mean()
    for name, gradient in zip(weights, net.gradients(rows, label)):
        array = getattr(net, name)
        for at in np.argsort(-np.abs(gradient), axis=None)[:3]:
            at = np.unravel_index(at, array.shape)
            before, step = array[at], 1e-6
            array[at] = before + step
            up = loss()
            array[at] = before - step
            down = loss()
            array[at] = before
            assert abs((up - down) / (2 * step) - gradient[at]) < 1e-4, name


def test_languages_are_learned_and_odd_texts_have_defined_results(spark):
    rows = [(i, speech(lang, i, 5 + i % 60), lang, "s", i) for i in range(90) for lang in TONGUES]
    rows += [(500, None, "aa", "s", 0), (501, "", "aa", "s", 0), (502, "1234 !!", "bb", "s", 0), (503, speech("aa", 1, 30), None, "s", 0), (None, speech("bb", 1, 4000), "bb", "s", 0)]
    docs = table(spark, rows).repartition(3)
    net = fit_language_network(docs, steps=150)
    assert net.languages == sorted(TONGUES)
    fresh = [(i, speech(lang, 1000 + i, 20 + 300 * (i % 3)), None, lang, 0) for i in range(20) for lang in TONGUES]
    got = predict_language(table(spark, fresh + rows[-5:]), net, carry=[F.col("doc_id"), F.col("source")]).collect()
    assert [r.lang_pred for r in got[:-5]] == [r.source for r in got[:-5]] and all(0.5 < r.score <= 1 for r in got[:-5])
    assert [(r.lang_pred, r.score) for r in got[-5:-2]] == [("und", 0.0)] * 3 and [r.lang_pred for r in got[-2:]] == ["aa", "bb"]


def test_prediction_does_not_depend_on_the_other_rows(spark):
    rows = [(100 * i + k, speech(lang, i, 1 + 40 * i), lang, "s", i) for i in range(12) for k, lang in enumerate(TONGUES)]
    net = fit_language_network(table(spark, rows), steps=20)
    together = {r.doc_id: (r.lang_pred, r.score) for r in predict_language(table(spark, rows), net).collect()}
    for row in rows[::7]:
        alone = predict_language(table(spark, [row]), net).first()
        assert (alone.lang_pred, pytest.approx(alone.score, abs=1e-5)) == together[row[0]]


def test_windows_do_not_see_into_the_next_text():
    texts = [b"a" * n for n in (0, 1, 251, 252, 253, 255, 256, 257, 508, 512, 600)]
    together, owner, inside = windows_of([t for text in texts for t in (text, b"zzzz")])
    for i, text in enumerate(texts):
        alone, _, starts = windows_of([text])
        assert (together[owner == 2 * i] == alone).all() and list(inside[owner == 2 * i]) == list(starts), len(text)


def test_networks_without_labels(spark):
    docs = table(spark, [(1, "words", None, "s", 0), (2, None, "aa", "s", 0)])
    assert [(r.lang_pred, r.score) for r in predict_language(docs, fit_language_network(docs)).collect()] == [("und", 0.0)] * 2
    one = fit_language_network(table(spark, [(1, "words", "aa", "s", 0)]))
    assert [(r.lang_pred, r.score) for r in predict_language(docs, one).collect()] == [("aa", 1.0), ("und", 0.0)]
    assert predict_language(table(spark, []), one).collect() == []


def test_sample_is_bounded_and_spread_over_texts(spark):
    rows = [(i, speech(lang, i, 900), lang, "s", i) for i in range(40) for lang in TONGUES]
    sample = language_id.sampled_windows(table(spark, rows).select(F.col("doc_id").alias("key"), "text", "lang"), 10, 3, 2).collect()
    assert len({r.lang for r in sample}) == 2 and len(sample) <= 60 and {len(r.window) for r in sample} == {WINDOW + 4}


def test_query_predicts_held_out_languages(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op11_language_id(spark, sf).join(queries.documents(spark, sf).select("doc_id", "lang", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("code")), "doc_id").collect()
    assert len(got) == 1000 and all(r.held_out == (r.code % 4 == 2) and 0 <= r.score <= 1 for r in got)
    held = [r.lang == r.lang_pred for r in got if r.held_out]
    assert sum(held) >= 0.97 * len(held) > 0
