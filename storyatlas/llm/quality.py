"""Quality classification by co-training of two views.

One view sees the text's content alone: hashed runs of three and of five bytes, and how much
of it repeats; the other what is known of a page besides its text: language, source and
declared length.  Each view is a naive Bayes classifier: for each class it counts shares of
features, every document weighing alike.  Labelled documents are counted in both views.  Over some
rounds every document without a label is scored by both; where one view is confident, the
document is counted with that label in the other one.  All documents take part: counts
are added up in the tasks and by Spark, and only the tables of counts, of a fixed size,
reach the driver.  The views are calibrated on labelled documents that are kept apart, and
combined by their reliability there.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import calibrate, sigmoid, stacked
from .scratch import sized_broadcast, small_batches, store
from .tokens import chunks

#: Labelled rows kept apart that the calibration sees at most, taken by hash of their id.
CALIBRATION_ROWS = 16_000
#: Text that is worked on at once.
WORKED_BYTES = 1 << 20
#: Buckets of a view's features.
BUCKETS = 1 << 16
#: Bytes of the runs that are the features of the content.
RUNS = (3, 5)
#: Documents' worth of prior counts, spread over all buckets, for each class.
PRIOR = 20.0
#: Steps of the share that is left of a text when it is packed.
PACKED_STEPS = 25
#: Counts and weights are whole multiples of these, so that sums do not depend on the order of rows.
COUNT_UNIT, WEIGHT_UNIT = 2.0**-24, 2.0**-16
VIEWS = ("content", "page")
#: Kinds of features of each view.
KINDS = {"content": len(RUNS) + 1, "page": 1}


def _bucket(kind: str, value: object) -> int:
    return zlib.crc32(f"{kind}:{'' if value is None else f'v{value}'}".encode()) % BUCKETS


@dataclass
class Features:
    """Features of a batch's rows in one view: buckets, and where each row's begin and end."""

    buckets: np.ndarray
    begins: np.ndarray
    ends: np.ndarray

    def sizes(self) -> np.ndarray:
        return self.ends - self.begins

    def mean(self, weights: np.ndarray) -> np.ndarray:
        """The mean weight of each row's features, 0 without any."""
        upto = np.concatenate([[0], np.cumsum(weights[self.buckets])])
        return (upto[self.ends] - upto[self.begins]) * WEIGHT_UNIT / np.maximum(self.sizes(), 1)

    def counts(self, rows: np.ndarray) -> np.ndarray:
        """Shares of the buckets, added up over ``rows``, in COUNT_UNIT."""
        own = np.zeros(len(self.buckets) + 1)  # where a row's features begin its share is added, and taken off where they end
        share = np.where(rows, (1 / COUNT_UNIT) // np.maximum(self.sizes(), 1), 0.0)
        np.add.at(own, self.begins, share)
        np.subtract.at(own, self.ends, share)
        return np.bincount(self.buckets, np.cumsum(own[:-1]), BUCKETS)


def content_features(texts: pa.Array) -> list[Features]:
    """For each length of runs, the hashed runs of bytes of each text; then how small it packs, alone and with its size."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    out = []
    for size in RUNS:
        code = np.zeros(max(len(data) - size + 1, 0), np.uint64)
        for i in range(size):
            code = (code << np.uint64(8)) | data[i : len(data) - size + 1 + i].astype(np.uint64) if len(code) else code
        code = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 16)
        begins = np.minimum(bounds[:-1], len(code))
        out.append(Features(code.astype(np.int64), begins, np.maximum(begins, np.minimum(bounds[1:] - size + 1, len(code)))))
    rows, raw = [], data.tobytes()
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        share = len(zlib.compress(raw[a:b], 1)) * PACKED_STEPS // (b - a) if b > a else None
        rows.append([_bucket("packed", share), _bucket("packed size", (share, (b - a).bit_length()))])
    each = np.arange(len(rows)) * 2
    return [*out, Features(np.array(rows, np.int64).reshape(-1), each, each + 2)]


def page_features(batch: pa.RecordBatch) -> list[Features]:
    """Language, source, the declared length's power of two, and pairs of them."""
    rows = []
    for lang, source, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True):
        size = None if n is None else int(n).bit_length()
        rows.append([_bucket("lang", lang), _bucket("source", source), _bucket("size", size), _bucket("lang source", (lang, source)), _bucket("source size", (source, size))])
    each = np.arange(len(rows)) * 5
    return [Features(np.array(rows, np.int64).reshape(-1), each, each + 5)]


def features_of(batch: pa.RecordBatch) -> dict[str, list[Features]]:
    return {"content": content_features(batch.column("text")), "page": page_features(batch)}


@dataclass
class View:
    """Weights of the buckets for each kind of feature, and a calibration."""

    weights: list[np.ndarray]
    slopes: np.ndarray
    offset: float = 0.0

    @staticmethod
    def of(counts: np.ndarray) -> View:
        """``counts``: kind of feature x class x bucket, in documents."""
        share = (counts + PRIOR / BUCKETS) / (counts.sum(axis=2, keepdims=True) + PRIOR)
        return View([np.rint(np.log(s[1] / s[0]) / WEIGHT_UNIT).astype(np.int64) for s in share], np.ones(len(counts)))

    def raw(self, features: list[Features]) -> np.ndarray:
        """The mean weight of the features, a column for each kind."""
        return np.column_stack([f.mean(w) for f, w in zip(features, self.weights, strict=True)])

    def scored(self, raw: np.ndarray) -> np.ndarray:
        return (raw * self.slopes).sum(axis=1) + self.offset  # not by @, whose sums may differ from batch to batch

    def score(self, features: list[Features]) -> np.ndarray:
        return self.scored(self.raw(features))


@dataclass
class QualityModel:
    views: dict[str, View]
    mix: tuple[float, float, float] = (0.5, 0.5, 0.0)
    #: Documents with a smaller score are rejected.
    cut: float = 0.0

    def score(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seen = features_of(batch)
        s, t = (self.views[v].score(seen[v]) for v in VIEWS)
        return sigmoid(self.mix[0] * s + self.mix[1] * t + self.mix[2]), sigmoid(s), sigmoid(t)


def _apart(key: str) -> Column:
    """Every fourth labelled document, for the calibration."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(11)), F.lit(4)) == 3


#: Places in which the tasks' counts are added up.
GROUPS = 8
_KEY = ["grp", "view", "kind", "cls"]
_COUNTS = "grp long, view long, kind long, cls long, n binary"


def _group() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() % GROUPS


def _count_rows(group: int, total: dict[str, np.ndarray]) -> pa.RecordBatch:
    keys = [(group, number, kind, cls) for number, v in enumerate(VIEWS) for kind in range(KINDS[v]) for cls in (0, 1)]
    data = [total[VIEWS[v]][kind, cls].astype(np.int64).tobytes() for _, v, kind, cls in keys]
    return pa.RecordBatch.from_arrays([*(pa.array(c) for c in zip(*keys, strict=True)), pa.array(data, pa.binary())], [*_KEY, "n"])


def _counted(rows: DataFrame, model: QualityModel | None, confidence: float) -> dict[str, np.ndarray]:
    """Counts for each view: of labelled rows, and with a model of those that the other view is confident of."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {v: np.zeros((KINDS[v], 2, BUCKETS)) for v in VIEWS}
        for batch in chunks(batches, most=WORKED_BYTES):
            label = pc.fill_null(batch.column("label"), -1).to_numpy()
            seen = features_of(batch)
            given = {v: label for v in VIEWS}
            if model is not None:
                for one, other in (VIEWS, VIEWS[::-1]):
                    p = sigmoid(model.views[one].score(seen[one]))
                    sure = np.where(p >= confidence, 1, np.where(p <= 1 - confidence, 0, -1))
                    given[other] = np.where(label >= 0, label, sure)
            for v in VIEWS:
                for kind, features in enumerate(seen[v]):
                    for cls in (0, 1):
                        if (given[v] == cls).any():
                            total[v][kind, cls] += features.counts(given[v] == cls)
        yield _count_rows(_group(), total)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, ...], np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(c)[i].as_py() for c in _KEY)
                own = np.frombuffer(batch.column("n")[i].as_buffer(), np.int64)
                sums[key] = sums[key] + own if key in sums else own
        for key, n in sums.items():
            yield pa.RecordBatch.from_arrays([*(pa.array([k]) for k in key), pa.array([n.tobytes()], pa.binary())], [*_KEY, "n"])

    # a row of counts for each task, view, kind and class; they are added up in GROUPS places, and then over these, so that the driver gets one table
    each = rows.mapInArrow(count, _COUNTS).repartition(*_KEY).mapInArrow(added, _COUNTS)
    with small_batches(rows.sparkSession):
        got = each.withColumn("grp", F.lit(0).cast("long")).repartition(*_KEY[1:]).mapInArrow(added, _COUNTS).toArrow()
    out = {v: np.zeros((KINDS[v], 2, BUCKETS)) for v in VIEWS}
    for batch in got.to_batches():
        view, kind, cls = (batch.column(c).to_pylist() for c in _KEY[1:])
        for i, n in enumerate(batch.column("n")):
            out[VIEWS[view[i]]][kind[i], cls[i]] += np.frombuffer(n.as_buffer(), np.int64) * COUNT_UNIT
    return out


def _calibrated(model: QualityModel, apart: DataFrame, good_loss: float) -> None:
    """Calibrate the views and their combination on labelled rows that they were not fitted on, and choose the cut there."""

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=WORKED_BYTES):
            seen = features_of(batch)
            cols = [pa.array(c, pa.float64()) for v in VIEWS for c in model.views[v].raw(seen[v]).T]
            yield pa.RecordBatch.from_arrays([*cols, batch.column("label")], names)

    names = [f"{v}{i}" for v in VIEWS for i in range(KINDS[v])] + ["label"]
    with small_batches(apart.sparkSession):
        got = apart.mapInArrow(raw, ", ".join(f"{c} double" for c in names[:-1]) + ", label int").toArrow()  # about CALIBRATION_ROWS rows at most
    cols = [got.column(c).to_numpy() for c in names]
    cols = [c[np.lexsort(cols)] for c in cols]  # as partitions may come in any order
    z = cols[-1].astype(float)
    if not len(z) or z.min() == z.max():
        return
    scored, at = [], 0
    for v in VIEWS:
        own, view = np.column_stack(cols[at : at + KINDS[v]]), model.views[v]
        view.slopes, view.offset = stacked(own, z)
        scored.append(view.scored(own))
        at += KINDS[v]
    s, t = scored
    best, least = (1.0, 0.0), np.inf
    for share in np.linspace(0, 1, 21):
        both = share * s + (1 - share) * t
        loss = np.mean(np.logaddexp(0, both) - z * both)
        if loss < least - 1e-9:
            best, least = (float(share), float(1 - share)), loss
    a, b = calibrate(best[0] * s + best[1] * t, z)
    a = a if a > 0 else 1.0
    model.mix = (a * best[0], a * best[1], b)
    good = sigmoid(model.mix[0] * s + model.mix[1] * t + b)[z > 0]
    model.cut = min(0.5, float(np.quantile(good, good_loss, method="lower")))


def _inputs(docs: DataFrame, text_col: str) -> list[Column]:
    """What the views see; columns that ``docs`` lacks are NULL."""
    kinds = {"lang": "string", "source": "string", "n_chars": "long"}
    return [F.col(text_col).alias("text"), *((F.col(c) if c in docs.columns else F.lit(None)).cast(k).alias(c) for c, k in kinds.items())]


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), *_inputs(docs, text_col))


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", rounds: int = 2, confidence: float = 0.97, good_loss: float = 0.005, calibration_rows: int = CALIBRATION_ROWS) -> QualityModel:
    """Fit on all labelled documents but every fourth, which are kept apart, and in ``rounds`` on all others.

    An id that ``labels`` repeats has its largest label.  Without labels of both kinds every
    document gets their share, and none is rejected.
    """
    known = labels.select(F.col(id_col).cast("long").alias("_k"), F.col(label_col).cast("int").alias("label")).where("label IN (0, 1) AND _k IS NOT NULL").groupBy("_k").agg(F.max("label").alias("label"))
    known = store(known.withColumn("_apart", _apart("_k")), "labels")
    counts = {(r["label"], r["_apart"]): r["n"] for r in known.groupBy("label", "_apart").agg(F.count("*").alias("n")).collect()}  # four rows
    total = sum(counts.values())
    by_class = [counts.get((c, True), 0) + counts.get((c, False), 0) for c in (0, 1)]
    if not all(counts.get((c, False)) for c in (0, 1)):
        share = (by_class[1] + 1) / (total + 2)
        model = QualityModel({v: View.of(np.zeros((KINDS[v], 2, BUCKETS))) for v in VIEWS})
        model.mix = (0.0, 0.0, float(np.log(share / (1 - share))))
        return model
    named = _rows(docs, id_col, text_col).join(sized_broadcast(known, total), F.col("doc_id") == F.col("_k"), "left")
    train = named.where("NOT coalesce(_apart, false)").select("text", "lang", "source", "n_chars", "label")
    n_apart = sum(n for (_, a), n in counts.items() if a)
    some = F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, calibration_rows / max(n_apart, 1)))
    apart = named.where(F.col("_apart") & some).select("text", "lang", "source", "n_chars", "label")

    def fitted(rows: DataFrame, model: QualityModel | None) -> QualityModel:
        new = QualityModel({v: View.of(c) for v, c in _counted(rows, model, confidence).items()})
        _calibrated(new, apart, good_loss)
        return new

    model = fitted(train.where("label IS NOT NULL"), None)
    for _ in range(rounds):
        model = fitted(train, model)
    return model


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **fitting) -> DataFrame:
    """doc_id, score, content_score, page_score, kept for each row of ``docs``.

    ``score``: probability of label 1.  Rows below the cut are rejected: 1/2, or less if that would
    reject more than ``good_loss`` of the good documents that were kept apart.  NULL texts are empty;
    an empty text has no content, and its content score is the calibration's offset.  NULL or missing
    lang, source and n_chars are values of their own.  Rows that repeat an id are scored each.
    Without labels of both kinds every row gets their share, so nothing is rejected for lack of labels.
    An empty table gives an empty result; other columns are ignored.
    """
    model = fit_quality(docs, labels, id_col, text_col, label_col, **fitting)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=WORKED_BYTES):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, pa.float64()) for c in model.score(batch))], ["doc_id", "score", "content_score", "page_score"])

    scored = _rows(docs, id_col, text_col).mapInArrow(score, "doc_id long, score double, content_score double, page_score double")
    return scored.withColumn("kept", F.col("score") >= model.cut)


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **fitting) -> DataFrame:
    """The rows of ``docs``, whole, that are not rejected; see ``score_quality``.  No shuffle."""
    model = fit_quality(docs, labels, id_col, text_col, label_col, **fitting)

    @F.arrow_udf("double")
    def score(rows: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for structs in rows:
            batch = pa.RecordBatch.from_struct_array(structs)
            yield pa.array(np.concatenate([model.score(c)[0] for c in chunks(iter([batch]), most=WORKED_BYTES)] or [np.zeros(0)]), pa.float64())

    return docs.where(score(F.struct(*_inputs(docs, text_col))) >= model.cut)
