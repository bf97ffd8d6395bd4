"""Best-fit packing of token sequences, in bulk-synchronous supersteps.

The pieces still to be placed and the gaps of the open sequences are tables; a
superstep places what it can, writes both anew, and the next one reads them.
Pieces go from long to short, band by band, as in best fit decreasing:

* ``match``: gaps and pieces are range-sorted together by size, descending.  In
  that order a piece takes the smallest gap before it that is still free, its
  best fit: every task resolves its own range as a stack, pieces that meet an empty
  stack and gaps that stay on it keep their rank, and ranks that cross ranges are
  resolved from a table of one row per task.  A gap takes one piece; gaps shrink.
* ``lay``: pieces much shorter than the gaps are laid end to end in rank order,
  along the gaps in ascending order.  A windowed sweep gives each piece the
  gap before it; a piece across the end of a gap loses and tries again.
* ``open``: pieces that fit nowhere open sequences by rank, as many to a
  sequence as certainly fit; what makes no full sequence goes to the next band.

Every superstep is a constant number of shuffles of narrow rows, and their number
does not depend on the number of documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranking import ranked
from .scratch import small_table, store
from .tokens import CHUNK_BYTES, encoded

#: Gaps and pieces that a task of a superstep sorts, about.
TASK_ROWS = 200_000
#: Shares of the capacity at which bands of pieces end; the last band reaches down to 1.
BANDS = (2, 3, 4, 8, 16, 64)
#: Bands that begin at this share of the capacity or below are laid first.
LAID = 16
#: Sweeps of ``match`` that a band has at most while they still place this share of its pieces.
SWEEPS, WORTHWHILE = 2, 0.03
#: Turns of the last band, in which few pieces lose, before the rest opens sequences.
LAST_TURNS = 3
#: Coordinates that a window of ``lay`` spans, in capacities.
STRETCH = 64


def stack_matches(is_piece: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows by size, descending: matched gaps and their pieces, then free pieces and free gaps (all as places).

    A gap is put on a stack, a piece takes the gap on top.  Free pieces all stand before free gaps.
    """
    height = np.cumsum(np.where(is_piece, -1, 1))
    low = np.minimum.accumulate(np.minimum(height, 0))
    free = is_piece & (low < np.concatenate([[0], low[:-1]]))
    rows = np.flatnonzero(~free)
    level = np.cumsum(np.where(is_piece[rows], -1, 1)) + is_piece[rows]
    rows = rows[np.argsort(level, kind="stable")]  # by level, a gap stands before the piece that takes it
    level = np.sort(level, kind="stable")
    hit = np.flatnonzero(is_piece[rows[1:]] & ~is_piece[rows[:-1]] & (level[1:] == level[:-1]))
    gaps, pieces = rows[hit], rows[hit + 1]
    left = np.setdiff1d(rows, np.concatenate([gaps, pieces]))
    return gaps, pieces, np.flatnonzero(free), left


def crossings(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """From (task, free pieces, free gaps) by task: (task, from rank, to rank, task of the gaps, rank of the first gap).

    Free pieces take the last free gaps of the tasks before; ranks of gaps descend as those of pieces ascend.
    """
    stack: list[list[int]] = []
    out = []
    for task, pieces, gaps in sorted(counts):
        at = 0
        while at < pieces and stack:
            n = min(pieces - at, stack[-1][1])
            out.append((task, at, at + n, stack[-1][0], stack[-1][1] - 1))
            at += n
            stack[-1][1] -= n
            if not stack[-1][1]:
                stack.pop()
        if gaps:
            stack.append([task, gaps])
    return out


def _task() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def _whole(batches: Iterator[pa.RecordBatch], names: list[str]) -> list[np.ndarray]:
    """The columns of all batches of a task."""
    held = [[b.column(c).to_numpy() for c in names] for b in batches if b.num_rows]
    return [np.concatenate(x) for x in zip(*held, strict=True)] if held else []


_SWEPT = "task int, kind int, id long, mate long, size long, place long"


def _swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """kind 2: the piece ``id`` took the sequence ``mate``, whose gap was ``place``; 1 and 0: free pieces and gaps with their rank."""
    cols = _whole(batches, ["kind", "id", "size"])
    if not cols:
        return
    kind, ident, size = cols
    gaps, pieces, free, left = stack_matches(kind == 1)
    none = np.full(max(len(free), len(left)), -1)
    for k, at, mate, place in ((2, pieces, ident[gaps], size[gaps]), (1, free, none[: len(free)], np.arange(len(free))), (0, left, none[: len(left)], np.arange(len(left)))):
        full = np.full(len(at), _task(), np.int32), np.full(len(at), k, np.int32), ident[at], mate, size[at], place
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in full], ["task", "kind", "id", "mate", "size", "place"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row with its task and the sum of the sizes before it, of its kind and task."""
    upto = {0: 0, 1: 0}
    for b in batches:
        kind, size = b.column("kind").to_numpy(), b.column("size").to_numpy()
        at = np.zeros(len(kind), np.int64)
        for k in (0, 1):
            own = kind == k
            ends = upto[k] + np.cumsum(size[own])
            at[own] = ends - size[own]
            upto[k] = int(ends[-1]) if len(ends) else upto[k]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(kind), _task(), np.int32)), b.column("kind"), b.column("id"), b.column("size"), pa.array(at)], ["task", "kind", "id", "size", "at"])


@dataclass
class _Packing:
    """The state between supersteps.  ``gaps``: seq, gap; ``todo``: pid, length; ``placed``: pid, seq, length, step."""

    spark: SparkSession
    capacity: int
    gaps: DataFrame
    todo: DataFrame
    n_gaps: int = 0
    n_todo: int = 0
    opened: int = 0  # sequences that were opened by number; those of pieces longer than half have the piece's
    step: int = 0
    placed: list[DataFrame] = field(default_factory=list)

    def _sorted(self, *order) -> DataFrame:
        rows = self.gaps.select(F.lit(0).alias("kind"), F.col("seq").alias("id"), F.col("gap").alias("size")).unionByName(self.todo.select(F.lit(1).alias("kind"), F.col("pid").alias("id"), F.col("length").alias("size")))
        n = -(-(self.n_gaps + self.n_todo) // TASK_ROWS)
        return rows.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def _place(self, rows: DataFrame) -> None:
        self.placed.append(rows.select("pid", "seq", "length", F.lit(self.step).alias("step")))

    def match(self) -> int:
        """Give pieces their best fits, one to a gap; how many were placed."""
        self.step += 1
        swept = store(self._sorted(F.desc("size"), F.col("kind"), F.col("id")).mapInArrow(_swept, _SWEPT), "swept")
        counts = swept.groupBy("task").agg(*(F.count_if(F.col("kind") == k).alias(f"n{k}") for k in (0, 1))).collect()  # a row a task
        met = crossings([(r["task"], r["n1"], r["n0"]) for r in counts])
        free, left, own = swept.where("kind = 1"), swept.where("kind = 0"), swept.where("kind = 2")
        hits = own.select(F.col("id").alias("pid"), F.col("mate").alias("seq"), F.col("size").alias("length"), F.col("place").alias("gap"))
        n = sum(r["n1"] for r in counts) - sum(b - a for _, a, b, _, _ in met)
        if met:
            table = F.broadcast(small_table(self.spark, met, "_p int, _from long, _to long, _g int, _top long"))  # at most two rows a task
            sent = free.join(table, (F.col("task") == F.col("_p")) & (F.col("place") >= F.col("_from")) & (F.col("place") < F.col("_to")), "left")
            far = left.select(F.col("task").alias("_g"), F.col("place").alias("_at"), F.col("id").alias("seq"), F.col("size").alias("gap"))
            cross = sent.where("_p IS NOT NULL").select(F.col("id").alias("pid"), F.col("size").alias("length"), "_g", (F.col("_top") - F.col("place") + F.col("_from")).alias("_at"))
            hits = hits.unionByName(store(cross.join(far, ["_g", "_at"]).select("pid", "seq", "length", "gap"), "crossed"))
            free = sent.where("_p IS NULL")
            left = left.join(table, (F.col("task") == F.col("_g")) & (F.col("place") <= F.col("_top")) & (F.col("place") > F.col("_top") - F.col("_to") + F.col("_from")), "left_anti")
        self._place(hits)
        self.gaps = hits.select("seq", (F.col("gap") - F.col("length")).alias("gap")).where("gap > 0").unionByName(left.select(F.col("id").alias("seq"), F.col("size").alias("gap")))
        self.todo = free.select(F.col("id").alias("pid"), F.col("size").alias("length"))
        done, self.n_todo = self.n_todo - n, n
        return done

    def lay(self, least: int, opening: bool) -> None:
        """Lay pieces along the gaps of at least ``least``; ``opening``: and along as many new sequences as are needed."""
        self.step += 1
        idle, self.gaps = self.gaps.where(F.col("gap") < least), self.gaps.where(F.col("gap") >= least)
        order = (F.col("kind"), F.when(F.col("kind") == 1, -F.col("size")).otherwise(F.col("size")), F.col("id"))
        laid = store(self._sorted(*order).mapInArrow(_summed, "task int, kind int, id long, size long, at long"), "laid")
        sums = {(r["task"], r["kind"]): r["n"] for r in laid.groupBy("task", "kind").agg(F.sum("size").alias("n")).collect()}  # two rows a task
        total, bases = {0: 0, 1: 0}, []
        for (task, kind), n in sorted(sums.items()):
            bases.append((task, kind, total[kind]))
            total[kind] += n
        base = F.broadcast(small_table(self.spark, bases, "task int, kind int, _base long"))
        laid = laid.join(base, ["task", "kind"]).select("kind", "id", "size", (F.col("_base") + F.col("at")).alias("start"))
        gaps, pieces = laid.where("kind = 0"), laid.where("kind = 1")
        if opening and total[1] > total[0]:
            n = -(-(total[1] - total[0]) // self.capacity)
            number = F.col("id")
            gaps = gaps.unionByName(self.spark.range(n).select(F.lit(0).alias("kind"), (-1 - self.opened - number).alias("id"), F.lit(self.capacity).cast("long").alias("size"), (total[0] + number * self.capacity).alias("start")))
            self.opened, self.n_gaps = self.opened + n, self.n_gaps + n
        wide = STRETCH * self.capacity  # so that a gap reaches into two stretches at most
        reached = gaps.where(F.col("start") < total[1])
        rows = reached.withColumn("_w", F.explode(F.array_distinct(F.array(F.expr(f"start DIV {wide}L"), F.expr(f"(start + size - 1) DIV {wide}L")))))
        rows = rows.unionByName(pieces.withColumn("_w", F.expr(f"start DIV {wide}L")))
        order = Window.partitionBy("_w").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
        swept = rows.withColumn("_g", F.last(F.when(F.col("kind") == 0, F.struct("id", "start", "size")), ignorenulls=True).over(order)).where("kind = 1")
        fits = F.col("start") + F.col("size") <= F.col("_g.start") + F.col("_g.size")
        fitted = store(swept.select(F.col("id").alias("pid"), F.col("size").alias("length"), F.when(fits, F.col("_g.id")).alias("seq")), "fitted")
        hits = fitted.where("seq IS NOT NULL")
        self._place(hits)
        used = hits.groupBy(F.col("seq").alias("id")).agg(F.sum("length").alias("_used"))
        left = gaps.join(used, "id", "left").select(F.col("id").alias("seq"), (F.col("size") - F.coalesce("_used", F.lit(0))).alias("gap")).where("gap > 0")
        self.gaps = store(left.unionByName(idle), "gaps")
        self.todo = fitted.where("seq IS NULL").select("pid", "length")
        self.n_todo = self.todo.count()

    def open(self, all_: bool = False) -> None:
        """Open sequences for pieces that fit nowhere, by rank; what would not fill one stays, unless ``all_`` are wanted."""
        self.step += 1
        longest = F.lit(self.todo.agg(F.max("length")).first()[0]) if all_ else F.col("length")
        rows = self.todo.withColumn("_q", (F.lit(self.capacity) / longest).cast("long")).withColumn("_down", -F.col("length"))
        rows = ranked(rows, ["_q"], ["_down", "pid"], "_rank", -(-self.n_todo // TASK_ROWS))
        rows = store(rows.select("pid", "length", "_q", "_rank"), "opening")
        plan, n = [], 0
        for r in rows.groupBy("_q").agg(F.count("*").alias("n")).orderBy("_q").collect():  # a row for each number of pieces to a sequence
            opened = -(-r["n"] // r["_q"]) if all_ else r["n"] // r["_q"]
            plan.append((r["_q"], opened * r["_q"], self.opened))
            self.opened, self.n_gaps, n = self.opened + opened, self.n_gaps + opened, n + max(0, r["n"] - opened * r["_q"])
        rows = rows.join(F.broadcast(small_table(self.spark, plan, "_q long, _full long, _first long")), "_q")
        new = rows.where("_rank < _full").select("pid", "length", (-1 - F.col("_first") - F.expr("_rank DIV _q")).alias("seq"))
        self._place(new)
        self.gaps = self.gaps.unionByName(new.groupBy("seq").agg((self.capacity - F.sum("length")).alias("gap")).where("gap > 0"))
        self.todo, self.n_todo = rows.where("_rank >= _full").select("pid", "length"), n


def best_fit(pieces: DataFrame, capacity: int) -> DataFrame:
    """``pieces`` (pid, length), with different pids and lengths from 1 to ``capacity`` -> pid, seq, offset.

    ``pieces`` must be a stored table, as it is read for every band.
    """
    bounds = sorted({capacity // b for b in BANDS} - {0}, reverse=True) + [0]
    band = sum(((F.col("length") <= b).cast("int") for b in bounds[:-1]), F.lit(0))
    sizes = {r["b"]: r["n"] for r in pieces.groupBy(band.alias("b")).agg(F.count("*").alias("n")).collect()}  # a row a band
    alone = pieces.where(F.col("length") > bounds[0]).select("pid", F.col("pid").alias("seq"), "length")
    state = _Packing(pieces.sparkSession, capacity, alone.select("seq", (F.lit(capacity) - F.col("length")).alias("gap")).where("gap > 0"), alone.select("pid", "length").limit(0), n_gaps=sizes.get(0, 0))
    state._place(alone)
    for i, (high, low) in enumerate(zip(bounds, bounds[1:], strict=False), 1):
        own = pieces.where((F.col("length") > low) & (F.col("length") <= high)).select("pid", "length")
        if sizes.get(i):
            state.todo = state.todo.unionByName(own) if state.n_todo else own
            state.n_todo += sizes[i]
        last = low == 0
        for _ in range(LAST_TURNS if last else 1):
            laid = last or high * LAID <= capacity
            if state.n_todo and laid:
                state.lay(low + 1, opening=last)
            for _ in range(1 if laid else SWEEPS):
                if state.n_todo and state.n_gaps:
                    n = state.n_todo
                    if state.match() <= WORTHWHILE * n:
                        break
        if state.n_todo:
            state.open(all_=last)
    placed = state.placed[0]
    for rows in state.placed[1:]:
        placed = placed.unionByName(rows)
    before = F.sum("length").over(Window.partitionBy("seq").orderBy("step", F.desc("length"), "pid"))
    return placed.select("pid", "seq", (before - F.col("length")).alias("offset"))


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The ids of every document, cut where they pass ``capacity``: one row per piece."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail = int(end_id).to_bytes(4, "little")
        for batch, ids, bounds in encoded(batches, tokenizer, most=slice_bytes):
            n = np.diff(bounds) + 1
            pieces = -(-n // capacity)
            row = np.repeat(np.arange(len(n)), pieces)
            number = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = number * capacity
            size = np.minimum(n[row] - start, capacity)
            data = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
            begin, last = bounds[row] + start, start + size == n[row]
            crc = [zlib.crc32(tail, zlib.crc32(data[4 * b : 4 * (b + s - 1)])) if z else zlib.crc32(data[4 * b : 4 * (b + s)]) for b, s, z in zip(begin.tolist(), size.tolist(), last.tolist(), strict=True)]
            cols = [batch.column("doc_id").take(pa.array(row)), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(size, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(cut, _PIECES)


def pack_best_fit(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece.

    NULL texts are empty: their end id alone.  Rows that repeat an id are
    documents of their own.  Sequences are filled without gaps from offset 0.
    An empty table gives an empty result; other columns are ignored.
    ``slice_bytes`` of text are encoded at once; smaller slices take more time and less memory.
    """
    pieces = token_pieces(docs, tokenizer, end_id, capacity, id_col, text_col, slice_bytes).withColumn("pid", F.monotonically_increasing_id())
    pieces = store(pieces, "pieces")  # the numbers hold from here on
    found = best_fit(pieces, capacity)
    return pieces.join(found, "pid").select("doc_id", "piece", "start", "length", "ids_crc32", F.col("seq").alias("sequence_id"), "offset")
