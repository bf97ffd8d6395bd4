"""Line deduplication: lines that several documents share stay in one of them.

Lines are exploded and normalised, each key is hashed (128 bits of its SHA-256),
and the distinct documents of every hash are counted.  Lines whose count reaches
the threshold go, except in the smallest document that holds them; what is left
is put together by position.

Hashes are stored once; only they and row numbers cross the network for the counting.  Texts cross it
once, to meet the positions that they lose.  Keys that hold more than a
``1 / SHARE`` part of all lines, of which there are ``SHARE`` at most, are found
by a broadcast; the rest, none of which is long, by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import ascii_lower
from .scratch import numbered, store, unused

SPACE = " \t\n\x0b\x0c\r"
#: At most this many keys are broadcast: those that hold more than this part of all lines.
SHARE = 20_000


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z in lower case."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _hash(key: Column) -> Column:
    return F.unhex(F.substring(F.sha2(key, 256), 1, 32))


def _lost(rows: DataFrame, min_docs: int, min_length: int) -> DataFrame:
    """``rows`` (_row, _doc, _lines) -> _row, _gone: the sorted positions that each row loses (rows that lose none are absent)."""
    lines = rows.select("_row", "_doc", F.posexplode("_lines").alias("_pos", "_line")).withColumn("_key", line_key(F.col("_line")))
    lines = store(lines.where(F.length("_key") >= min_length).select("_row", "_doc", "_pos", _hash(F.col("_key")).alias("_hash")), "line-hashes")
    # rows without an id are one document, which keeps nothing that another one holds
    docs = F.count_distinct("_doc") + F.max(F.col("_doc").isNull().cast("int"))
    counted = lines.groupBy("_hash").agg(F.count("*").alias("_n"), docs.alias("_docs"), F.min("_doc").alias("_keeper"))
    shared = store(counted.where(F.col("_docs") >= min_docs).where("_keeper IS NOT NULL").select(F.col("_hash").alias("_h"), "_n", "_keeper"), "shared-lines")
    total = shared.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    often = F.col("_n") * SHARE > total
    lines = lines.join(F.broadcast(shared.where(often).select("_h", F.col("_keeper").alias("_hot"))), F.col("_hash") == F.col("_h"), "left").drop("_h")
    hot = lines.where("_hot IS NOT NULL AND NOT _doc <=> _hot").select("_row", "_pos")
    rest = lines.where("_hot IS NULL").join(shared.where(~often), F.col("_hash") == F.col("_h")).where("NOT _doc <=> _keeper").select("_row", "_pos")
    return hot.unionByName(rest).groupBy("_row").agg(F.sort_array(F.collect_list("_pos")).alias("_gone"))


def drop_shared_lines(docs: DataFrame, min_docs: int = 2, min_length: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (what is left), n_lines and n_dropped (long) for each row of ``docs``.

    A text is split at line feeds; NULL and the empty text are one empty line.  A
    key has at least ``min_length`` code points and is found in at least
    ``min_docs`` documents, or all its lines stay.  The smallest document that
    holds a key keeps each of its lines, also repeated ones.  A text that loses
    every line becomes empty.  Rows that repeat an id are one document when
    documents are counted; NULL ids are one document, which comes after all others.
    Other columns of ``docs`` are ignored.  An empty table gives an empty result.
    """
    row = unused(docs, "_row")
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    rows = numbered(docs, row).select(F.col(row).alias("_row"), F.col(id_col).alias("_doc"), lines.alias("_lines"))
    lost = _lost(rows, min_docs, min_length).withColumnRenamed("_row", "_r")
    # flags up to the last lost line, in one walk; joining leaves out NULLs
    before = F.concat(F.array(F.lit(-1)), F.slice("_gone", F.lit(1), F.size("_gone") - 1))
    flags = F.flatten(F.zip_with(before, F.col("_gone"), lambda a, b: F.concat(F.array_repeat(F.lit(False), b - a - 1), F.array(F.lit(True)))))
    kept = F.array_join(F.zip_with(F.col("_lines"), flags, lambda line, gone: F.when(gone, F.lit(None)).otherwise(line)), "\n")
    return rows.join(lost, F.col("_row") == F.col("_r"), "left").select(
        F.col("_doc").alias("doc_id"),
        F.when(F.col("_gone").isNull(), F.array_join("_lines", "\n")).otherwise(kept).alias("text"),
        F.size("_lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
