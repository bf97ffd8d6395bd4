"""Sharding by proportional stratified interleaving.

Rows are put in seeded random order within their source.  A row's fractional
rank is (its rank + 1/2) / (rows of its source).  Sorted by fractional rank the
sources interleave in proportion, so equal cuts of that order each hold the
whole mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import ranked
from .scratch import store


def stratified_shards(docs: DataFrame, shards: int, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row.

    Law ``rows``: the rows of any two shards differ by one at most, and a
    shard's rows of one source by a few.  ``size`` is the UTF-8 bytes of the text plus
    16; a NULL text has none and the checksum of the empty text.  NULL sources
    are a source.  Rows that repeat an id are kept; equal rows are
    interchangeable.  An empty table gives an empty result.
    """
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)) + 16).cast("long").alias("size"),
        crc.alias("text_crc32"),
        F.col(source_col).alias("_source"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("_shuffle"),
    )
    rows = store(rows, "shard-rows")
    inner = ranked(rows, ["_source"], ["_shuffle", "doc_id", "text_crc32", "size"], "_rank")
    sizes = inner.groupBy(F.col("_source").alias("_s")).agg(F.count("*").alias("_of"))
    inner = inner.join(sizes, F.col("_source").eqNullSafe(F.col("_s")))
    placed = inner.select("doc_id", "size", "text_crc32", "_shuffle", "_source", ((F.col("_rank") + 0.5) / F.col("_of")).alias("_fraction"))
    total = rows.count()
    order = ranked(placed, [], ["_fraction", "_source", "_shuffle", "doc_id", "text_crc32", "size"], "_place")
    # shard s takes the places from ceil(s * total / shards) on
    shard = F.expr(f"CAST(_place * {shards}L DIV {max(total, 1)}L AS INT)")
    start = F.expr(f"(CAST(shard AS BIGINT) * {max(total, 1)}L + {shards - 1}L) DIV {shards}L")
    return order.withColumn("shard", shard).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("_place") - start).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
