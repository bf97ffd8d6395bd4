"""Tables that grow by batches and survive a crash at any step: folders of Parquet files, and a manifest that names those that count.

A batch is written to a folder of its own and counts from the moment a new manifest names it; a manifest appears
by one rename.  What a crash leaves behind is named by none, so no reader sees it, and the next write clears it.
``FAN`` folders of one level are merged to one of the next, so that a row is rewritten a few times (the logarithm of the
number of batches) and few folders are open at any time.  A store has one writer at a time and any number of
readers: a folder stays until two manifests without it have appeared.
"""

from __future__ import annotations

import json
import math
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Folders of a level that become one of the next.
FAN = 8
#: Rows in a file of a merged folder, about.
FILE_ROWS = 5_000_000


@dataclass
class Store:
    """The store at ``path``; it need not exist."""

    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        self.path = self.path.rstrip("/")
        self._hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def _listed(self, name: str) -> list[str]:
        place = self._at(name)
        return [s.getPath().getName() for s in self._fs.listStatus(place)] if self._fs.exists(place) else []

    def _versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._listed("_manifests") if n.endswith(".json") and n[:-5].isdigit())

    def _tables(self, version: int) -> list[dict]:
        stream = self._fs.open(self._at(f"_manifests/{version}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def tables(self) -> list[dict]:
        """name, level and rows of the folders that count."""
        versions = self._versions()
        return self._tables(versions[-1]) if versions else []

    def rows(self, schema: T.StructType | str) -> DataFrame:
        """What the store holds now; later batches do not change it."""
        names = [f"{self.path}/{t['name']}" for t in self.tables()]
        return self.spark.read.schema(schema).parquet(*names) if names else self.spark.createDataFrame([], schema)

    def _publish(self, tables: list[dict]) -> None:
        """The next manifest, by one rename; then what the last two do not name is cleared."""
        version = (self._versions() or [0])[-1] + 1
        fresh = self._at(f"_manifests/{uuid.uuid4().hex}.new")
        out = self._fs.create(fresh, True)
        try:
            out.write(bytearray(json.dumps(tables).encode()))
        finally:
            out.close()
        place = self._at(f"_manifests/{version}.json")
        if self._fs.exists(place) or not self._fs.rename(fresh, place):
            raise OSError(f"{self.path} has another writer: version {version} is there")
        self.clear()

    def clear(self) -> None:
        """Delete folders that neither of the last two manifests names, and older manifests."""
        last = self._versions()[-2:]
        named = {t["name"] for v in last for t in self._tables(v)}
        for name in self._listed(""):
            if name.startswith("rows-") and name not in named:
                self._fs.delete(self._at(name), True)
        for name in self._listed("_manifests"):
            if name not in {f"{v}.json" for v in last}:
                self._fs.delete(self._at(f"_manifests/{name}"), False)

    def _write(self, df: DataFrame, level: int) -> dict:
        name = f"rows-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.path}/{name}")
        # counted from the files' footers
        return {"name": name, "level": level, "rows": self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}").count()}

    def add(self, df: DataFrame) -> int:
        """Add the rows of ``df`` as one batch, all or none; how many there are.  No rows make no batch."""
        table = self._write(df, 0)
        if table["rows"]:
            self._publish([*self.tables(), table])
        else:
            self._fs.delete(self._at(table["name"]), True)
        return table["rows"]

    def compact(self, schema: T.StructType | str, key: str, fan: int = FAN, file_rows: int = FILE_ROWS) -> int:
        """Merge ``fan`` folders of a level to one of the next, sorted by ``key``, until no level has as many; how many merges were made."""
        merges = 0
        while True:
            tables = self.tables()
            full = sorted(lv for lv in {t["level"] for t in tables} if sum(t["level"] == lv for t in tables) >= fan)
            if not full:
                return merges
            old = [t for t in tables if t["level"] == full[0]][:fan]
            merged = self.spark.read.schema(schema).parquet(*(f"{self.path}/{t['name']}" for t in old))
            files = max(1, math.ceil(sum(t["rows"] for t in old) / file_rows))
            table = self._write(merged.repartitionByRange(files, F.col(key)).sortWithinPartitions(key), full[0] + 1)
            if table["rows"] != sum(t["rows"] for t in old):
                raise OSError(f"{table['name']} lacks rows of the folders that it merges")
            gone = {t["name"] for t in old}
            self._publish([t for t in tables if t["name"] not in gone] + [table])
            merges += 1
