"""Exact deduplication by deterministic block naming (DataFrame functions only).

The normalised text is cut into fixed-size blocks.  Distinct blocks are sorted
and named by integers; then adjacent pairs of names are named in the same way,
again and again, until each document has one name.  Two documents get the same
name exactly if their texts are equal.

Text crosses the network once, in the aggregation that finds distinct blocks.
Documents find their blocks' names by a 64-bit locator.  A locator that stands
for more than one distinct block (which the aggregation sees, as it compares
contents) is resolved by a second join on the content itself, so names stay
free of collisions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import numbered, store, unused, without

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLOCK_BYTES = 4096


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone.  ``lower`` is the same for texts of ASCII, and faster."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _UPPER.lower()))


def _blocks(rows: DataFrame, block_bytes: int, locator_bits: int) -> DataFrame:
    """One row per block: its place and the bytes.  An empty text is one empty block."""
    count = F.greatest(F.ceil(F.octet_length("_text") / F.lit(block_bytes)), F.lit(1))
    cut = rows.withColumn("_pos", F.explode(F.sequence(F.lit(0), (count - 1).cast("int"))))
    cut = cut.withColumn("_block", F.substring(F.col("_text").cast("binary"), F.col("_pos") * block_bytes + 1, F.lit(block_bytes)))
    return cut.withColumn("_loc", F.shiftright(F.xxhash64("_block"), 64 - locator_bits))


def block_names(rows: DataFrame, block_bytes: int = BLOCK_BYTES, locator_bits: int = 64) -> DataFrame:
    """``rows`` (_rid, _text, ...) -> all but _text, and _level, _name: equal texts get equal (level, name)."""
    kept = [c for c in rows.columns if c != "_text"]
    rest = [c for c in kept if c != "_rid"]
    blocks = _blocks(rows, block_bytes, locator_bits)
    distinct = blocks.groupBy("_loc", "_block").agg(F.lit(1).alias("_one")).sortWithinPartitions("_loc", "_block")
    names = store(distinct.select("_loc", F.monotonically_increasing_id().alias("_name")), "names")
    first = F.struct(*[F.col(c) for c in rest]) if rest else F.struct(F.lit(0))
    placed = store(blocks.select("_rid", "_pos", "_loc", F.when(F.col("_pos") == 0, first).alias("_info")), "placed")
    info = placed.where("_pos = 0").select("_rid", *[F.col(f"_info.{c}").alias(c) for c in rest])
    one = store(names.groupBy("_loc").agg(F.count("*").alias("_n"), F.min("_name").alias("_name")), "locators")
    named = placed.join(one.where("_n = 1").select("_loc", "_name"), "_loc").select("_rid", "_pos", "_name")
    clash = one.where("_n > 1").select("_loc")
    if not clash.isEmpty():
        # several blocks share a locator: name and join these by their content
        some = blocks.join(clash, "_loc", "left_semi").select("_rid", "_pos", "_block")
        own = some.groupBy("_block").agg(F.lit(1).alias("_one")).sortWithinPartitions("_block")
        own = store(own.select("_block", (-1 - F.monotonically_increasing_id()).alias("_name")), "clash")
        named = named.unionByName(some.join(own, "_block").select("_rid", "_pos", "_name"))
    named, done, level = store(named, "level"), None, 0
    while True:
        last = named.groupBy("_rid").agg(F.max("_pos").alias("_last"), F.min("_name").alias("_name"))
        whole = last.where("_last = 0").select("_rid", F.lit(level).alias("_level"), "_name")
        done = whole if done is None else done.unionByName(whole)
        pairs = named.join(last.where("_last > 0").select("_rid"), "_rid", "left_semi").groupBy("_rid", F.expr("CAST(_pos DIV 2 AS INT)").alias("_pos")).agg(
            F.min(F.when(F.col("_pos") % 2 == 0, F.col("_name"))).alias("_left"),
            F.min(F.when(F.col("_pos") % 2 == 1, F.col("_name"))).alias("_right"),
        )
        pairs = store(pairs, "pairs")
        if pairs.isEmpty():
            return info.join(done, "_rid")
        level += 1
        uniq = pairs.groupBy("_left", "_right").agg(F.lit(1).alias("_one")).sortWithinPartitions("_left", "_right")
        uniq = store(uniq.select(F.col("_left").alias("_l"), F.col("_right").alias("_r"), F.monotonically_increasing_id().alias("_name")), "names")
        same = (F.col("_left") == F.col("_l")) & F.col("_right").eqNullSafe(F.col("_r"))
        named = store(pairs.join(uniq, same).select("_rid", "_pos", "_name"), "level")


def _groups(docs: DataFrame, row: str, id_col: str, text_col: str, block_bytes: int, locator_bits: int) -> DataFrame:
    """_rid, _id, _sha, _keep (id and row number), group_size for each row of ``docs`` with the row number ``row``."""
    rows = docs.select(F.col(id_col).alias("_id"), ascii_lower(F.coalesce(F.col(text_col), F.lit(""))).alias("_text"), F.col(row).alias("_rid"))
    rows = rows.withColumn("_sha", F.sha2("_text", 256))
    named = store(block_names(rows, block_bytes, locator_bits), "identity")
    groups = named.groupBy("_level", "_name").agg(F.count("*").alias("group_size"), F.max(F.struct("_id", "_rid")).alias("_keep"))
    return named.join(store(groups, "groups"), ["_level", "_name"])


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, locator_bits: int = 64) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of ``docs``.

    Texts are equal when identical after lower-casing A-Z; NULL counts as empty.
    Of equal texts the row with the largest id stays; NULL ids come below all
    others, and of rows that repeat an id, one stays.  Other columns of ``docs``
    are ignored.  An empty table gives an empty result.
    """
    row = unused(docs, "_row")
    return _groups(numbered(docs, row), row, id_col, text_col, block_bytes, locator_bits).select(
        F.col("_id").alias("doc_id"),
        F.col("_keep._id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("_rid") == F.col("_keep._rid")).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, whole, that ``exact_dedup`` keeps."""
    row = unused(docs, "_row")
    docs = numbered(docs, row)
    gone = _groups(docs, row, id_col, text_col, block_bytes, 64).where(F.col("_rid") != F.col("_keep._rid"))
    return without(docs, row, gone.select(F.col("_rid").alias(row)))
