"""Rendezvous hashing of stable keys over weighted shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import rank_in_groups


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (position in ``weights``) with the best draw for ``key``; -1 if there is none.

    A shard's draw depends on the key and its own number only, so one more shard takes records from others and moves
    none between them, and a share grows with its weight. A draw is 52 bits of the MD5 of "key:shard", taken as a
    number u in (0, 1) and compared as ln(u) / weight.
    """
    draws = []
    for shard, weight in enumerate(weights):
        if weight > 0:
            bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 13), 16, 10).cast("double")
            u = (bits + 0.5) / F.lit(float(1 << 52))
            draws.append(F.struct((F.log(u) / F.lit(float(weight))).alias("draw"), F.lit(-shard).alias("shard")))
    if not draws:
        return F.lit(-1)
    best = F.greatest(*draws) if len(draws) > 1 else draws[0]
    return (-best["shard"]).cast("int")


def rendezvous_shards(
    docs: DataFrame,
    weights: Sequence[float],
    grown_weights: Sequence[float],
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per document: ``doc_id, size, text_crc32, law, shard, slot, grown_shard``.

    ``size`` is the text's UTF-8 bytes plus 8, ``slot`` numbers a shard's rows from 0 along ``doc_id`` without gaps,
    ``grown_shard`` is the shard under ``grown_weights``. Only the id and the weights decide, so repeated ids share a
    shard; null ids are hashed as an empty key and come first in it. Null texts are empty. An empty table gives an
    empty result; other columns are not read.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    )
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = rows.select(
        "*", F.lit("key").alias("law"), rendezvous(key, weights).alias("shard"), rendezvous(key, grown_weights).alias("grown_shard")
    )
    ranked = rank_in_groups(rows, ["shard"], ["doc_id", "text_crc32"], "shards")
    return ranked.select("doc_id", "size", "text_crc32", "law", "shard", F.col("rank").alias("slot"), "grown_shard")
