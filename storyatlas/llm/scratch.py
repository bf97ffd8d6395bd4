"""Intermediate tables that every executor can read.

Lineage is cut by writing a Parquet table into the folder named by
``spark.checkpoint.dir``: files there outlive lost executors, and what is read
back has known sizes, so that adaptive execution can split skewed joins.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

_CONF = "spark.checkpoint.dir"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: No file that marks success, as nobody reads a table before its write has returned: on local folders every file
#: and folder that is made starts a process beside the JVM, which for a moment counts the JVM's memory again.
_UNMARKED = {"mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
#: Rows that a Python worker gets at once at most.
BATCH_ROWS = 1024


def scratch_root(spark: SparkSession) -> str:
    """The shared folder.  A machine-local one is made only for a local master."""
    root = spark.conf.get(_CONF, None)
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        root = "file://" + tempfile.mkdtemp(prefix="storyatlas-")
    else:
        root = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    spark.conf.set(_CONF, root)
    return root


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While jobs of this module run, fewer rows go to a Python worker at once, as rows hold whole texts; then as before."""
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def store(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return it read back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/storyatlas/{name}-{uuid.uuid4().hex}"
    with small_batches(spark):
        df.write.options(**_UNMARKED).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few ``rows`` of the driver as a table.  They go by Arrow: tuples would start a second daemon of Python with workers in every executor."""
    if not rows:
        return spark.createDataFrame([], schema)
    kinds = to_arrow_schema(StructType.fromDDL(schema))
    columns = [pa.array(list(values), kind.type) for values, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=kinds), schema)


def sized_broadcast(df: DataFrame, rows: int, limit: int = 1_000_000):
    """Broadcast ``df`` when its counted ``rows`` are few; else leave the join to Spark."""
    return F.broadcast(df) if rows <= limit else df


def _located(docs: DataFrame) -> bool:
    """Whether each row of ``docs`` is a row of a Parquet file, and of one only."""
    plan = docs._jdf.queryExecution().optimizedPlan()
    lines = [line for line in plan.toString().splitlines() if line.strip()]
    if not plan.deterministic() or not all(re.match(r"[\s:+-]*(Project|Filter|Relation .*parquet$)", line) for line in lines):
        return False
    if "Relation" not in lines[-1]:
        return False
    files = list(plan.collectLeaves().head().relation().location().inputFiles())
    return len(files) == len(set(files))


def numbered(docs: DataFrame, row: str) -> DataFrame:
    """``docs`` with the column ``row``, a number that names a row in every job.

    It is made of the row's file and its place there, which do not depend on how a scan is
    split.  What is not a plain scan of Parquet files is stored first.
    """
    docs = docs if _located(docs) else store(docs, "docs")
    meta = docs.metadataColumn("_metadata")
    path, at, first = (unused(docs, f"{row}_{x}") for x in ("path", "at", "first"))
    paths = sorted(r[0] for r in docs.select(meta["file_path"]).distinct().collect())  # one for each file
    files = small_table(docs.sparkSession, [(p, n << 40) for n, p in enumerate(paths)], f"{path} string, {first} long")
    placed = docs.select("*", meta["file_path"].alias(path), meta["row_index"].alias(at)).join(F.broadcast(files), path)
    return placed.withColumn(row, F.col(first) + F.col(at)).drop(path, at, first)


def unused(docs: DataFrame, stem: str) -> str:
    """A column name that ``docs`` does not have."""
    while stem.lower() in {c.lower() for c in docs.columns}:
        stem += "_"
    return stem


def without(docs: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """``docs`` (with the row number ``row``) without the rows numbered in ``dropped``."""
    dropped = store(dropped, "dropped")
    return docs.join(sized_broadcast(dropped, dropped.count()), row, "left_anti").drop(row)
