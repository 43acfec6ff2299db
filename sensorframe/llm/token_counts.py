"""Token counts through a digest cache.

The cache is a table of (content digest, tokenizer version digest, token count). Documents are joined to it by digest;
only distinct contents that it lacks are encoded, and their counts are appended. Only digests travel to find them: the
smallest id with a digest stands for it, so copies of one text, however many, are encoded once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, functions as F

from ..scratch import pin
from .bpe import slabs
from .common import batch_of, body

#: Runs of text without ASCII white space that a task remembers with their counts.
CACHE_RUNS = 400_000
_COUNTS = pa.schema([("digest", pa.string()), ("n_tokens", pa.int64())])
CACHE_COLUMNS = "digest string, version string, n_tokens long"


def normalised(text: Column) -> Column:
    """Runs of ASCII white space as one space, none at the ends: vocabularies that drop white space count both alike."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "))


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    cache_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 2048,
) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    ``tokenizer_path`` names a tokenizers file whose pretokens never hold white space (it is checked on a sample
    string); special strings in a text count as the library counts them. ``cache_path`` is a Parquet folder in storage
    that all executors share; it is made where missing, and one cache serves many tokenizers. Null texts are empty and
    count 0 tokens; repeated rows and null ids are returned as they come; an empty table gives none and appends
    nothing. A lost cache entry is only encoded again; entries written twice count once. Other columns are not read.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    probe = Tokenizer.from_file(tokenizer_path)
    if len(probe.encode("a b\n\t c", add_special_tokens=False).ids) != sum(
        len(probe.encode(x, add_special_tokens=False).ids) for x in "abc"
    ):
        raise ValueError("this tokenizer counts white space; its runs cannot be counted one by one")
    spec = probe.to_str()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = Tokenizer.from_str(spec)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        known: dict[bytes, int] = {}
        for digests, texts in slabs(batches):
            if len(known) > CACHE_RUNS:
                known.clear()
            # bytes.split() splits at exactly the ASCII white space that no token crosses
            new: set[bytes] = set()
            for text in texts:
                new |= set(text.split()).difference(known)
            runs = list(new)
            for i in range(0, len(runs), 20_000):
                part = runs[i : i + 20_000]
                coded = tokenizer.encode_batch_fast([r.decode("utf-8", "replace") for r in part], add_special_tokens=False)
                known.update(zip(part, map(len, coded)))
            yield batch_of(_COUNTS, (digests, [sum(map(known.__getitem__, t.split())) for t in texts]))

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.sha2(normalised(text), 256).alias("digest"),
    )
    rows = pin(rows, "token-digests")
    try:
        cached = spark.read.schema(CACHE_COLUMNS).parquet(cache_path)
    except AnalysisException:
        cached = spark.createDataFrame([], CACHE_COLUMNS)
    cached = cached.where(F.col("version") == version).select("digest", "n_tokens")
    owners = rows.groupBy("digest").agg(F.min("doc_id").alias("owner"))
    missing = pin(owners.join(cached, "digest", "left_anti"), "token-misses")
    whole = docs.select(F.col(id_col).cast("long").alias("owner"), body(text_col).alias("body"), F.sha2(normalised(text), 256).alias("d"))
    first = whole.join(missing, whole["owner"].eqNullSafe(missing["owner"]) & (whole["d"] == missing["digest"]), "left_semi")
    fresh = first.select(F.col("d").alias("digest"), "body").mapInArrow(count, "digest string, n_tokens long")
    # rows repeated with the owner's id stand for it as well
    fresh = fresh.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    fresh.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache_path)
    stored = spark.read.schema(CACHE_COLUMNS).parquet(cache_path).where(F.col("version") == version)
    stored = stored.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))
    return rows.join(stored, "digest").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
