"""The registered queries of this subpackage: production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..scratch import pin, scratch_path
from .bpe import BpeTables, encode_documents
from .exact_dedup import exact_groups
from .host_reputation import host_reputation
from .jaccard_join import jaccard_components
from .language_id import fit_language_network, predict_language
from .manifest import COLUMNS, folded, merkle_manifest, row_digest, siblings
from .packing import pack_documents
from .quality_model import fit_quality, quality_features, score_quality
from .quality_rules import quality_rules
from .secret_scan import find_secrets, labelled_samples, listed, train_markov
from .sharding import rendezvous_shards
from .spelling import spelling_groups
from .token_counts import token_counts

BYTE_BPE, WORD_BPE = "byte_bpe_50k.json", "word_bpe_49k.json"
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]
SHARDS = 24
LIFT = 2.0


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def byte_tables() -> BpeTables:
    return BpeTables(public_tokenizers.path(BYTE_BPE))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(documents(spark, sf_dir), keep="largest")


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = pin(quality_features(documents(spark, sf_dir)), "quality-features")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = fit_quality(features.where(~held_out).join(labels, "doc_id"))
    scored = score_quality(features, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir))


def op4_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(documents(spark, sf_dir), byte_tables(), digests=True)


def op5_jaccard_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = scratch_path(spark, "token-cache")
    return token_counts(documents(spark, sf_dir), public_tokenizers.path(WORD_BPE), cache)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), byte_tables(), public_tokenizers.PATTERN)


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous_shards(documents(spark, sf_dir), [1.0] * SHARDS, [1.0] * (SHARDS + 1))


def page_is_bad() -> F.Column:
    """Outcome of a page by its content: symbols are more than a twentieth of what remains without tags."""
    plain = F.regexp_replace(F.coalesce("html", F.lit("")), r"<[^>]*>", "")
    symbols = F.length(plain) - F.length(F.translate(plain, "#*$%|&", ""))
    return F.when(F.length(plain) > 0, (20 * symbols > F.length(plain)).cast("int"))


def op9_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    judged = host_reputation(pages, page_is_bad(), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_host_reputation_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts are blocked where their pages are worse than ``LIFT`` times the whole table, at every size."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    judged = host_reputation(pages, page_is_bad(), URL_RULES, lift=LIFT)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = find_secrets(docs, train_markov(labelled_samples(docs)))
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("found")).alias("spans")
    )


def op11_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    net = fit_language_network(docs.where(~held_out))
    return predict_language(docs, net, carry=[F.col("doc_id"), held_out.alias("held_out")])


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    altered = row_digest([F.try_add(F.col(c), F.lit(1)) if c == "n_chars" else F.col(c) for c in COLUMNS])
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    proved = merkle_manifest(docs, carry=[F.when(chosen, altered).alias("altered")])
    beside = F.sha2(F.array_join(siblings(F.col("steps")), ""), 256)
    proved = proved.withColumn("folded_root", folded(F.coalesce("altered", "leaf"), F.col("steps")))
    return proved.select(
        "doc_id", "leaf", "subroot", "root", beside.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified")
    )


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_exact_dedup, op2_quality_model, op3_quality_rules, op4_bpe_round_trip, op5_jaccard_components,
        op6_token_counts, op7_best_fit_packing, op8_rendezvous_shards, op9_host_reputation, op9_host_reputation_lift, op10_secret_scan,
        op11_language_id, op12_merkle_manifest, op13_spelling_variants,
    )}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the operators that SQL can express."""
    return {
        "op1_exact_dedup": """
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents window g as (partition by coalesce(text, ''))""",
        "op5_jaccard_components": r"""
with recursive words as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w
    from documents
), shingles as (
    select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s
    from words
), sizes as (select doc_id, count(*) as n from shingles group by 1
), links as (
    select a.doc_id as x, b.doc_id as y from shingles a join shingles b on a.s = b.s and a.doc_id <> b.doc_id
    join sizes p on p.doc_id = a.doc_id join sizes q on q.doc_id = b.doc_id
    group by 1, 2, p.n, q.n having 100 * count(*) >= 80 * (p.n + q.n - count(*))
), reach as (
    select doc_id as x, doc_id as y from documents union select r.x, l.y from reach r join links l on l.x = r.y
)
select r.x as doc_id, coalesce(any_value(n), 0) as n_shingles, min(r.y) as component_id from reach r left join sizes on sizes.doc_id = r.x group by 1""",
        "op8_rendezvous_shards": _shards_sql(),
        "op9_host_reputation": _reputation_sql(),
        "op9_host_reputation_lift": _reputation_sql(f"(select {LIFT} * (k + 0.5) / (n + 1.0) from root)"),
        "op12_merkle_manifest": _manifest_sql(),
        "op13_spelling_variants": _spelling_sql(),
    }


def _prior_sql(children: str) -> str:
    return f"""(
    select least(1000.0, greatest(1.0, (1 - rho) / greatest(rho, 1e-6))) from (
        select case when g > 1 and room > 0 and rv > 0 then least(0.999, greatest(0.0, (s - rv * (g - 1)) / (rv * room))) else 1.0 end as rho
        from (select count(*) as g, sum(n * (k / n - parent) * (k / n - parent)) as s, sum(n * parent * (1 - parent)) / sum(n) as rv,
                     sum(n) - sum(n * n) / sum(n) - (count(*) - 1) as room
              from {children} where n > 0)))"""


def _reputation_sql(bar: str = "0.5") -> str:
    return rf"""
with plain as (
    select page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) as path,
           regexp_replace(coalesce(html, ''), '<[^>]*>', '', 'g') as t
    from pages
), seen as (
    select page_id, host, path, case when length(t) > 0 then cast(20 * (length(t) - length(translate(t, '#*$%|&', ''))) > length(t) as integer) end as bad from plain
), hosts as (
    select host, array_to_string(string_split(host, '.')[-2:], '.') as domain, string_split(host, '.')[-1] as suffix,
           cast(count(bad) as double) as n, cast(coalesce(sum(bad), 0) as double) as k from seen group by host
), root as (select sum(n) as n, sum(k) as k from hosts
), s0 as (select suffix, s.n, s.k, (root.k - s.k + 0.5) / (root.n - s.n + 1.0) as parent
          from (select suffix, sum(n) as n, sum(k) as k from hosts group by suffix) s, root
), s1 as (select *, {_prior_sql('s0')} as m from s0
), d0 as (select domain, d.n, d.k, (s1.k - d.k + s1.m * s1.parent) / (s1.n - d.n + s1.m) as parent
          from (select domain, suffix, sum(n) as n, sum(k) as k from hosts group by domain, suffix) d join s1 using (suffix)
), d1 as (select *, {_prior_sql('d0')} as m from d0
), h0 as (select host, h.n, h.k, (d1.k - h.k + d1.m * d1.parent) / (d1.n - h.n + d1.m) as parent from hosts h join d1 using (domain)
), h1 as (select host, (k + m * parent) / (n + m) as rate, n + m as weight from (select *, {_prior_sql('h0')} as m from h0)
), ruled as (
    select *, case
        when (host = 'example.net' or ends_with(host, '.example.net')) and starts_with(path, '/en/') then 'example.net/en/'
        when (host = 'example.com' or ends_with(host, '.example.com')) and starts_with(path, '/de/') then 'example.com/de/'
        when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/fr/') then 'org/fr/'
        when (host = 'net' or ends_with(host, '.net')) and starts_with(path, '/') then 'net/' end as rule
    from seen join h1 using (host)
)
select page_id, host, path, rule, case when rule in ('net/', 'example.com/de/') then 'block' when rule is not null then 'allow'
       when rate - 1.96 * sqrt(rate * (1 - rate) / (weight + 1)) > {bar} then 'block' else 'allow' end as verdict
from ruled"""


#: The CRC-32 of each byte, by its rule; 3988292384 is the reversed polynomial.
_CRC_TABLE = """crc as (
    select list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda x, i: case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end)) as t
)"""


def _crc_sql(text: str) -> str:
    """CRC-32 of the UTF-8 bytes of ``text``, with ``t`` of the table at hand."""
    hexed = f"hex(encode({text}))"
    bytes_ = f"list_transform(range(length({hexed}) // 2), lambda i: ('0x' || substr({hexed}, 2 * i + 1, 2))::bigint)"
    return f"xor(list_reduce(list_concat([4294967295], {bytes_}), lambda x, b: xor(x >> 8, t[1 + (xor(x, b) & 255)])), 4294967295)"


def _shards_sql() -> str:
    def best(shards: int) -> str:
        draws = f"list_transform(range({shards}), lambda s: ('0x' || substr(md5(coalesce(doc_id::varchar, '') || ':' || s), 1, 13))::bigint)"
        return f"list_position({draws}, list_max({draws})) - 1"

    return f"""
with {_CRC_TABLE}, rows as (
    select doc_id, coalesce(strlen(text), 0) + 8 as size, {_crc_sql("coalesce(text, '')")} as text_crc32, 'key' as law, ({best(SHARDS)})::integer as shard, ({best(SHARDS + 1)})::integer as grown_shard
    from documents, crc
)
select doc_id, size, text_crc32, law, shard, row_number() over (partition by shard order by doc_id nulls first, text_crc32) - 1 as slot, grown_shard from rows"""


def _manifest_sql() -> str:
    def field(v: str) -> str:
        return f"coalesce(strlen({v}::varchar) || ':' || {v}::varchar, '-')"

    doc_id, source, lang, n_chars, text, altered = map(field, ("doc_id", "source", "lang", "n_chars", "text", "(n_chars + 1)"))
    return f"""
with recursive {_CRC_TABLE}, digests as (
    select doc_id, lang, sha256(concat({doc_id}, {source}, {lang}, {n_chars}, {text})) as leaf,
           sha256(concat({doc_id}, {source}, {lang}, case when {_crc_sql('doc_id::varchar')} % 7 = 0 then {altered} else {n_chars} end, {text})) as altered
    from documents, crc
), leaves as (
    select *, row_number() over w - 1 as rank, count(*) over (partition by lang) as n from digests window w as (partition by lang order by doc_id nulls first, leaf)
), nodes as (
    select lang, 0 as level, rank, n, leaf as digest from leaves
    union all
    select lang, level + 1, rank // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by rank)) from nodes where n > 1 group by lang, level, rank // 2, n
), subroots as (
    select lang, digest as subroot, row_number() over (order by lang nulls first) - 1 as rank, count(*) over () as n from nodes where n = 1
), tops as (
    select 0 as level, rank, n, subroot as digest from subroots
    union all
    select level + 1, rank // 2, (n + 1) // 2, sha256(string_agg(digest, '' order by rank)) from tops where n > 1 group by level, rank // 2, n
), climb as (
    select doc_id, lang, leaf, altered as digest, '' as beside, 0 as level, rank, n from leaves
    union all
    select c.doc_id, c.lang, leaf, sha256(case when c.rank % 2 = 1 then s.digest || c.digest else c.digest || coalesce(s.digest, '') end),
           beside || coalesce(s.digest, ''), c.level + 1, c.rank // 2, (c.n + 1) // 2
    from climb c left join nodes s on s.lang is not distinct from c.lang and s.level = c.level and s.rank = xor(c.rank, 1) where c.n > 1
), onward as (
    select doc_id, leaf, subroot, digest, beside, 0 as level, s.rank, s.n from climb c join subroots s on s.lang is not distinct from c.lang where c.n = 1
    union all
    select doc_id, leaf, subroot, sha256(case when c.rank % 2 = 1 then s.digest || c.digest else c.digest || coalesce(s.digest, '') end),
           beside || coalesce(s.digest, ''), c.level + 1, c.rank // 2, (c.n + 1) // 2
    from onward c left join tops s on s.level = c.level and s.rank = xor(c.rank, 1) where c.n > 1
)
select doc_id, leaf, subroot, t.digest as root, sha256(beside) as proof_sha256, o.digest as folded_root, o.digest = t.digest as verified
from onward o, (select digest from tops where n = 1) t where o.n = 1"""


def _spelling_sql() -> str:
    return rf"""
with recursive {_CRC_TABLE}, runs as (
    select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]{{7,}}')) as run from documents
), seen as (select id, run, count(*) as n from runs group by all
), damaged as (select *, {_crc_sql("id || ':' || run")} as h from seen, crc
), cut as (
    select case when h % 31 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from damaged
), words as (select word, sum(n)::bigint as n from cut where length(word) >= 7 group by word having sum(n) >= 2
), shorter as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest, length(word) as size from words, lateral (select unnest(range(length(word))) as i)
), near as (
    select a.word, b.word as other, b.n as m from shorter a join shorter b on a.rest = b.rest and a.i = b.i and a.size = b.size and a.word <> b.word
    union select a.word, b.word, b.n from shorter a join words b on a.rest = b.word
    union select b.word, a.word, a.n from shorter a join words b on a.rest = b.word
), best as (
    select word, count(*) as n_near, max(m) as m, min(struct_pack(k := -m, other := other)).other as other from near group by word
), forms as (
    select words.word, words.n, coalesce(n_near, 0) as n_near, case when m >= 10 * words.n then other end as form, case when m >= 10 * words.n then m end as form_n
    from words left join best using (word)
), chain as (
    select word, word as root from forms
    union all
    select c.word, f.form from chain c join forms f on f.word = c.root where f.form is not null
)
select f.word, f.form, c.root, f.n, f.n_near, f.form_n from forms f join chain c using (word) join forms e on e.word = c.root where e.form is null"""
