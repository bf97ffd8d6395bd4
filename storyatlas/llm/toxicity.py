"""Toxicity scores by a counterfactually regularised linear classifier.

The classifier sees which words a text has.  In labelled texts that mention
groups of people, each term is swapped for others of the same kind, and the
difference between the scores of the text and of its counterfactuals is penalised:
what is learned must not hang on the group that is named.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .linear import Rows, calibrate, fit_logistic, rows_of, sigmoid
from .scratch import small_batches, store
from .tokens import chunks

# Terms that name groups, by kind; terms of a kind may stand for one another.
IDENTITY_TERMS = {
    "religion": ["christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic", "protestant"],
    "origin": ["african", "american", "asian", "european", "arab", "mexican", "chinese", "indian", "latino", "polish"],
    "colour": ["black", "white", "brown"],
    "gender": ["woman", "man", "female", "male", "transgender", "nonbinary"],
    "orientation": ["gay", "lesbian", "bisexual", "straight", "heterosexual", "homosexual"],
    "age": ["young", "old", "elderly", "teenage"],
    "ability": ["blind", "deaf", "disabled", "paralyzed"],
    "plural": ["women", "men", "christians", "muslims", "jews", "hindus", "immigrants", "refugees", "africans", "asians"],
}
#: Labelled rows that the classifier is fitted on at most, taken by hash of their id.
FIT_ROWS = 24_000
#: Counterfactuals of a text, each with other terms.
SWAPS = 2
#: A word is used if its share differs between the labels by this many standard errors, and it is not rarer than this.
SIGNIFICANT, LEAST_TEXTS = 2.5, 3
BITS = 22


def word_lists(texts: pa.Array) -> tuple[np.ndarray, list[str], np.ndarray]:
    """Words of the texts in lower case: codes, the words they stand for, and bounds by text.

    Words are runs of letters, digits and marks; their edges are stripped of other characters.
    """
    plain = pc.utf8_lower(pc.fill_null(texts, "").cast(pa.large_string()))
    lists = pc.utf8_split_whitespace(plain)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    words = pc.utf8_trim(coded.dictionary, "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~«»“”„‘’…–—¡¿")
    return coded.indices.to_numpy(), words.to_pylist(), bounds - bounds[0]


def _hash(word: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) >> (64 - BITS)


def _distinct(codes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes (below n) of each text, with new bounds."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    both = np.unique(row * n + codes) if len(row) else np.zeros(0, np.int64)
    return both % max(n, 1), np.searchsorted(both, np.arange(len(bounds)) * n)


_FEATURES = "doc_id long, label int, words array<long>, swapped array<array<long>>"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, label -> the hashed words of each text, and those of its counterfactuals (none without terms)."""
    kinds = {t: [u for u in terms if u != t] for terms in IDENTITY_TERMS.values() for t in terms}
    for batch in chunks(batches):
        codes, words, bounds = word_lists(batch.column("text"))
        hashed = np.array([_hash(w) for w in words], np.int64)
        codes, cuts = _distinct(codes, bounds, len(words))
        own, other = [], []
        named = np.array([w in kinds for w in words], bool)
        for i in range(batch.num_rows):
            mine = codes[cuts[i] : cuts[i + 1]]
            own.append(np.unique(hashed[mine]).tolist())
            terms = mine[named[mine]]
            fixed, turn = hashed[mine[~named[mine]]], sum(own[-1])  # the turn differs from text to text
            other.append([])
            for r in range(SWAPS if len(terms) else 0):
                swapped = [_hash(kinds[words[c]][(turn + r) % len(kinds[words[c]])]) for c in terms.tolist()]
                other[-1].append(np.unique(np.concatenate([fixed, swapped])).tolist())
        cols = [batch.column("doc_id"), batch.column("label"), pa.array(own, pa.list_(pa.int64())), pa.array(other, pa.list_(pa.list_(pa.int64())))]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "label", "words", "swapped"])


#: Weights are whole multiples of this, so that sums do not depend on the order of the words.
UNIT = 2.0**-32


class ToxicityModel:
    """Weights by hashed word, a bias and a calibration; small enough for every task."""

    def __init__(self, keys: np.ndarray, weights: np.ndarray, bias: float, slope: float, offset: float):
        self.keys, self.weights = keys, np.rint(weights / UNIT).astype(np.int64)
        self.bias, self.slope, self.offset = bias, slope, offset

    def of_words(self, words: list[str]) -> np.ndarray:
        hashed = np.array([_hash(w) for w in words], np.int64)
        if not len(self.keys):
            return np.zeros(len(words), np.int64)
        at = np.minimum(np.searchsorted(self.keys, hashed), len(self.keys) - 1)
        return np.where(self.keys[at] == hashed, self.weights[at], 0)

    def score(self, texts: pa.Array) -> np.ndarray:
        codes, words, bounds = word_lists(texts)
        codes, cuts = _distinct(codes, bounds, len(words))
        upto = np.concatenate([[0], np.cumsum(self.of_words(words)[codes])])
        return sigmoid(self.slope * ((upto[cuts[1:]] - upto[cuts[:-1]]) * UNIT + self.bias) + self.offset)


def fit_toxicity(labelled: DataFrame, fit_rows: int = FIT_ROWS, pair_weight: float = 0.5) -> ToxicityModel:
    """Fit on ``labelled`` (doc_id, text, label), at most ``fit_rows`` of it.

    NULL labels are left out.  Without both labels the score is the labels' share.
    The result depends on the rows alone, not on their order or partitions.
    """
    rows = labelled.where("label IS NOT NULL")
    total = rows.count()
    if total > fit_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * fit_rows / total))
    with small_batches(rows.sparkSession):
        got = rows.select("doc_id", "text", F.col("label").cast("int").alias("label")).mapInArrow(_features, _FEATURES).toArrow()
    ids = pc.fill_null(got.column("doc_id"), -1).to_numpy()
    y = got.column("label").to_numpy().astype(float)
    words, swapped = got.column("words").combine_chunks(), got.column("swapped").combine_chunks()
    sizes = pc.list_value_length(words).to_numpy()
    sums = np.add.reduceat(np.append(words.flatten().to_numpy(), 0), np.append(np.cumsum(sizes) - sizes, [0])[: len(y)]) * (sizes > 0) if len(y) else y
    order = np.lexsort((sums, sizes, y, ids))
    ids, y = ids[order], y[order]
    lists = [words[int(i)].values.to_numpy() for i in order]
    flat, bounds = np.concatenate(lists) if lists else np.zeros(0, np.int64), np.concatenate([[0], np.cumsum(sizes[order])])
    # words by how much their share differs between the labels, in standard errors
    keys, col = np.unique(flat, return_inverse=True)
    n1, n0 = max(y.sum(), 1.0), max(len(y) - y.sum(), 1.0)
    hit = np.bincount(col, np.repeat(y, np.diff(bounds)), len(keys))
    all_ = np.bincount(col, minlength=len(keys))
    share = all_ / (n1 + n0)
    z = (hit / n1 - (all_ - hit) / n0) / np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n1 + 1 / n0))
    named = np.isin(keys, [_hash(t) for terms in IDENTITY_TERMS.values() for t in terms])
    keys = keys[((np.abs(z) > SIGNIFICANT) & (all_ >= LEAST_TEXTS)) | named]

    def chosen(lists: list[np.ndarray]) -> Rows:
        out = []
        for x in lists:
            at = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
            out.append(at[keys[at] == x] if len(keys) else x[:0])
        return rows_of(out)

    x = chosen(lists)
    pairs = [(i, np.array(s, np.int64)) for i, o in enumerate(order) for s in swapped[int(o)].as_py()]
    of, other = np.array([i for i, _ in pairs], np.int64), chosen([s for _, s in pairs])

    def fit(rows: np.ndarray) -> tuple[np.ndarray, float]:
        own = np.flatnonzero(np.isin(of, rows))
        both = (x.take(of[own]), other.take(own)) if len(own) else None
        return fit_logistic(x.take(rows), y[rows], len(keys), l1=3e-4, pairs=both, pair_weight=pair_weight)

    # calibrated by the scores that the same kind of model gives to rows that it was not fitted on
    apart = np.array([zlib.crc32(str(i).encode()) % 5 == 4 for i in ids.tolist()], bool)
    w, b = fit(np.flatnonzero(~apart))
    slope, offset = calibrate(x.take(np.flatnonzero(apart)).dot(w) + b, y[apart])
    w, b = fit(np.arange(len(y)))
    kept = np.flatnonzero(w)
    return ToxicityModel(keys[kept], w[kept], b, slope if slope > 0 else 1.0, offset)


def _held(col: str) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(col).cast("string")), F.lit(4)) == 2, F.lit(False))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.3, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``.

    Rows whose crc32(id as text) mod 4 is 2 are held out: no label of theirs is
    learned.  The score sees the words of the text alone.  NULL texts are empty
    and get the score of no evidence; NULL ids are never learned from.  Rows that
    repeat an id are scored each; an empty table gives an empty result.
    """
    known = labels.select(F.col(id_col).alias("_k"), F.col(label_col).alias("label")).where(F.col("label").isNotNull() & F.col("_k").isNotNull())
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    wanted = known.where(~_held("_k"))
    total = wanted.count()
    if total > fit_rows:  # choose before the join, so that texts of other rows stay where they are
        wanted = wanted.where(F.pmod(F.xxhash64("_k"), F.lit(1 << 20)) < int((1 << 20) * fit_rows / total))
    wanted = store(wanted, "wanted")  # at most about ``fit_rows`` rows
    model = fit_toxicity(rows.join(F.broadcast(wanted), F.col("doc_id") == F.col("_k")).select("doc_id", "text", "label"), 2 * fit_rows)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(batch.column("text")), pa.float64())], ["doc_id", "score"])

    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", _held("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
