"""Importance resampling of documents towards a target's words.

Texts become arrays of word runs, which are exploded and hashed into buckets.  The
counts of all documents and of the target give each bucket a gain (the logarithm
of how much likelier the target is to use it), a table of one row a bucket.  A
document's weight is the mean gain of its features.  Gumbel noise seeded by the
document's id is added, so that taking the highest scores draws documents
without replacement in proportion to their weights.

All is DataFrame functions.  Counts are combined before the shuffle to one row a bucket
and task, sums to one row a document; ranks come from a range sort and the
partitions' offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import ascii_lower
from .ranking import ranked

#: What is no word: ASCII but for digits and lower-case letters.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of the text with A-Z in lower case; NULL has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NO_WORD, -1), "")


def runs(tokens: Column, longest: int) -> Column:
    """All runs of 1 to ``longest`` consecutive words, joined by one space, with repeats."""
    found, grams = [tokens], tokens
    for n in range(2, longest + 1):
        head = F.slice(grams, F.lit(1), F.greatest(F.size(grams) - 1, F.lit(0)))
        tail = F.slice(tokens, F.lit(n), F.greatest(F.size(tokens) - (n - 1), F.lit(0)))
        grams = F.zip_with(head, tail, lambda a, b: F.concat(a, F.lit(" "), b))
        found.append(grams)
    return F.concat(*found)


def _bucket(feature: str, buckets: int) -> Column:
    return (F.crc32(F.col(feature).cast("binary")) % buckets).cast("int")


def bucket_counts(texts: DataFrame, text_col: str, longest: int, buckets: int) -> DataFrame:
    """bucket, n: how many features of all ``texts`` fall into each bucket that has any."""
    rows = texts.select(words(F.col(text_col)).alias("_words")).select(runs(F.col("_words"), longest).alias("_runs"))
    # (what is empty is left out after the arrays are taken apart, or they would be made a second time to be measured)
    grams = rows.select(F.explode_outer("_runs").alias("_gram")).where("_gram IS NOT NULL")
    return grams.select(_bucket("_gram", buckets).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))


def gains(docs: DataFrame, target: DataFrame, text_col: str, target_col: str, longest: int, buckets: int) -> DataFrame:
    """bucket, gain (long) for each of the ``buckets``: at most that many rows."""
    source = bucket_counts(docs, text_col, longest, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    wanted = bucket_counts(target, target_col, longest, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t"))
    every = docs.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    table = every.unionByName(source).unionByName(wanted).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    # a row a bucket: the totals and the table itself are small whatever the input
    rows = sorted((r.bucket, r.s, r.t) for r in table.collect())
    all_s, all_t = sum(r[1] for r in rows), sum(r[2] for r in rows)
    table = docs.sparkSession.createDataFrame(rows, "bucket int, s long, t long")
    double = lambda c: c.cast("double")
    odds = double(F.col("t") + 1) * double(F.lit(all_s + buckets)) / (double(F.col("s") + 1) * double(F.lit(all_t + buckets)))
    return table.select("bucket", F.floor(1000 * F.log(odds)).alias("gain"))


def importance_resample(
    docs: DataFrame, target: DataFrame, percent: int = 25, seed: int = 7, longest: int = 2, buckets: int = 10_000, min_words: int = 20, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text"
) -> DataFrame:
    """doc_id, n_features, weight, score, rank (all long) for each row of ``docs``.

    ``rank`` counts the drawn documents from 1, highest score first, ties to the
    smaller id (NULL before all); it is NULL for the rest.  Documents of fewer
    than ``min_words`` words are scored, never drawn.  NULL and wordless texts
    have no features and weight 0.  A NULL id is written as the empty string for its
    noise.  Rows that repeat an id are rows of their own; equal ones are
    interchangeable.  An empty target gives gains against uniform counts.  An
    empty table gives an empty result; other columns are ignored.
    """
    table = gains(docs, target, text_col, target_col, longest, buckets)
    rows = docs.select(F.col(id_col).alias("doc_id"), words(F.col(text_col)).alias("_words")).withColumn("_row", F.monotonically_increasing_id())
    # no array goes along with the exploded rows
    rows = rows.select("_row", "doc_id", F.size("_words").alias("_size"), runs(F.col("_words"), longest).alias("_runs"))
    grams = rows.select("_row", "doc_id", "_size", F.explode_outer("_runs").alias("_gram"))
    grams = grams.select("_row", "doc_id", "_size", _bucket("_gram", buckets).alias("bucket"))
    # a document's rows come one after another in one task, so they are summed before the shuffle
    summed = grams.join(F.broadcast(table), "bucket", "left").groupBy("_row", "doc_id", "_size").agg(F.count("gain").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("_sum"))
    mean = F.when(F.col("n_features") == 0, F.lit(0)).otherwise(F.expr("(_sum - pmod(_sum, n_features)) DIV n_features")).cast("long")
    noise = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("long")
    gumbel = F.floor(-1000 * F.log(-F.log((noise + 0.5) / F.lit(4294967296.0))))
    scored = summed.select("doc_id", "n_features", mean.alias("weight"), (mean + gumbel).alias("score"), (F.col("_size") >= min_words).alias("_fit"), (-(mean + gumbel)).alias("_down"))
    # highest score first, then the smaller id; rows that may be drawn are ranked apart from the others
    placed = ranked(scored, ["_fit"], ["_down", "doc_id", "n_features", "weight"], "_place")
    sizes = placed.groupBy(F.col("_fit").alias("_f")).agg(F.count("*").alias("_n"))
    drawn = F.col("_fit") & (F.col("_place") < F.expr(f"_n * {percent}L DIV 100L"))
    return placed.join(F.broadcast(sizes), F.col("_fit") == F.col("_f")).select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("_place") + 1).cast("long").alias("rank"))
