"""The operators on small tables with awkward rows, against brute force."""

import bisect
import hashlib
import itertools
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from storyatlas.llm.ann import nearest
from storyatlas.llm.dedup import drop_exact_duplicates, exact_dedup
from storyatlas.llm.jaccard import drop_near_duplicates, jaccard_components
from storyatlas.llm.licenses import scan_licenses
from storyatlas.llm.mixing import mix_sources, mixed_documents
from storyatlas.llm.packing import pack_best_fit
from storyatlas.llm.quality import keep_quality, score_quality
from storyatlas.llm.queries import vocabulary
from storyatlas.llm.sharding import stratified_shards
from storyatlas.llm.toxicity import score_toxicity
from storyatlas.llm.wavelet import token_shards

#: doc_id, text, lang, source, n_chars, and columns whose names clash with inner ones.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank string, _rid int, _text string, size int, cid string"
LONG = " ".join(f"w{i}" for i in range(6000))


def doc(i, text, source="s1"):
    return (i, text, "en", source, len(text or ""), "r", 1, "t", 2, "c")


ROWS = [
    doc(1, "The same text É"), doc(2, "the SAME text É"), doc(3, "the same text é"), doc(4, None), doc(5, "", None), doc(6, " \n"),
    doc(7, LONG), doc(8, LONG.upper()), doc(9, LONG[:-9] + "x"), doc(10, "one two three"), doc(11, "ONE two\tthree"), doc(12, "one two four"),
    doc(None, "nobody's text"), doc(13, "repeated row"), doc(13, "repeated row"), (14, "no facts", None, None, None, None, None, None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 1), (7, 0, 0), (None, 1, 1), (10, None, None), (99, 1, 0)], "doc_id long, quality int, toxic int")


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


@pytest.mark.parametrize("bits,block", [(64, 4096), (2, 16), (64, 8)])
def test_exact_dedup(docs, bits, block):
    got = exact_dedup(docs, block_bytes=block, locator_bits=bits).collect()
    groups = {}
    for i, t, *_ in ROWS:
        groups.setdefault(lower(t), []).append(i)
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    key = lambda r: (str(r[0]), r[3])
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=key) == sorted(want, key=key)
    assert sum(r.kept for r in got) == len(groups)


def test_drop_exact(docs):
    left = drop_exact_duplicates(docs)
    assert left.columns == docs.columns and left.count() == len({lower(r[1]) for r in ROWS})


def shingles(t):
    w = re.findall("[^\x20\x09-\x0d]+", lower(t))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def classes(rows):
    sets = [shingles(r[1]) for r in rows]
    root = list(range(len(rows)))
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            old, new = root[j], root[i]
            root = [new if r == old else r for r in root]
    least = {r: min((rows[i][0] for i in range(len(rows)) if root[i] == r and rows[i][0] is not None), default=None) for r in set(root)}
    return sorted(((rows[i][0], len(sets[i]), least[root[i]]) for i in range(len(rows))), key=str), len(least)


def test_jaccard(docs):
    want, n = classes(ROWS)
    got = jaccard_components(docs).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert sum(r.kept for r in got) == n == drop_near_duplicates(docs).count()


def test_jaccard_near_the_threshold(spark, monkeypatch):
    """Chains of near copies around the threshold, in more than one block and with common signatures."""
    import storyatlas.llm.jaccard as J

    monkeypatch.setattr(J, "BLOCK", 4)
    monkeypatch.setattr(J, "MANY_BLOCKS", 1)
    rng = np.random.default_rng(7)
    rows = []
    for g in range(6):
        words = [f"g{g}w{i}" for i in range(int(rng.integers(8, 140)))]
        for _ in range(12):
            for k in rng.choice(len(words), 1 + len(words) // 60, replace=False):
                words[k] = f"x{rng.integers(1 << 30)}"
            rows.append((len(rows), " ".join(words)))
    want, n = classes(rows)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == want
    assert 6 < n < len(rows)


def test_shards(docs):
    got = stratified_shards(docs, 5).collect()
    sizes = sorted(sum(r.shard == s for r in got) for s in range(5))
    assert sizes == [3, 3, 3, 3, 4] and {r.law for r in got} == {"rows"}
    for s in range(5):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sorted((str(r.doc_id), r["size"], r.text_crc32) for r in got) == sorted((str(r[0]), len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in ROWS)


def test_shards_by_brute_force(spark, docs, sf):
    """Ranks within the source in seeded order, fractional ranks, and equal cuts, one row after another."""
    for table in (docs, spark.read.parquet(f"{sf}/documents.parquet")):
        facts = table.select("doc_id", "source", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"), F.crc32(F.coalesce("text", F.lit(""))).alias("c"), F.xxhash64(F.lit(17), "doc_id").alias("h")).collect()
        null_first = lambda x: (x is not None, x or 0)
        name = lambda s: (s is not None, s or "")
        order = sorted(facts, key=lambda f: (name(f.source), f.h, null_first(f.doc_id), f.c, f.n))
        placed = []
        for _, own in itertools.groupby(order, lambda f: f.source):
            own = list(own)
            placed += [((i + 0.5) / len(own), name(f.source), f.h, null_first(f.doc_id), f.c, f.n, f.doc_id) for i, f in enumerate(own)]
        placed.sort()
        total = len(placed)
        want = [(p[6], p[5] + 16, p[4], at * 7 // total, at - -(-(at * 7 // total) * total // 7)) for at, p in enumerate(placed)]
        got = [(r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in stratified_shards(table, 7).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_shards_match_the_mixture(spark):
    rows = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 10 < 7, "b").alias("source"))
    got = stratified_shards(rows, 7).join(rows.select("doc_id", "source"), "doc_id").groupBy("source", "shard").count().collect()
    for source in {r["source"] for r in got}:
        n = [r["count"] for r in got if r["source"] == source]
        assert len(n) == 7 and max(n) - min(n) <= 2
    again = stratified_shards(rows.repartition(9), 7)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, stratified_shards(rows, 7).collect()))


def test_mix(spark, docs, sf):
    got = mix_sources(docs).collect()
    words = {str(r[0]): len(re.findall("[^\x20\x09-\x0d]+", r[1] or "")) for r in ROWS}
    assert all(r["size"] == words[str(r.doc_id)] and r.taken <= 2 * r["size"] for r in got)
    table = spark.read.parquet(f"{sf}/documents.parquet")
    got = mix_sources(table).join(table.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.first("target").alias("t"), F.sum("taken").alias("n"), F.sum("size").alias("s"), F.max("size").alias("most")).collect()
    assert sum(r["t"] for r in got) == pytest.approx(1.5 * sum(r["s"] for r in got))
    assert all(abs(r["n"] - r["t"]) <= r["most"] for r in got)  # documents are taken whole, and here there are ten a source
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mix_sources(table).collect() if r["size"]}
    copies = {r["doc_id"]: r["count"] for r in mixed_documents(table).groupBy("doc_id").count().collect()}
    assert {k: v for k, v in taken.items() if v} == {k: v for k, v in copies.items() if k in taken}


def test_mix_overlapping(spark):
    rows = [(i, "a b c d", [["x"], ["y"], ["x", "y"], None][i % 4]) for i in range(80)]
    got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source array<string>"), weights=(1, 1), share=1.0)
    assert got.agg(F.sum("taken")).first()[0] == pytest.approx(320, abs=12)


def test_pack(docs):
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    got = pack_best_fit(docs, vocabulary("word_bpe_49k.json"), 1, 128).collect()
    want = []
    for i, t, *_ in ROWS:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        want += [(str(i), k, 128 * k, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(np.split(ids, range(128, len(ids), 128)))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    for _, own in itertools.groupby(sorted(got, key=lambda r: (r.sequence_id, r.offset)), lambda r: r.sequence_id):
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= 128
    assert len({r.sequence_id for r in got}) <= -(-sum(r.length for r in got) // 128) + 1


def test_packing_is_as_tight_as_best_fit(spark):
    """Lengths of several kinds, against plain best fit decreasing, one piece after another."""
    from storyatlas.llm.packing import best_fit
    from storyatlas.llm.scratch import store

    rng = np.random.default_rng(6)
    for lengths in (rng.integers(1, 257, 3000), np.minimum(rng.lognormal(3.5, 1.0, 4000).astype(int) + 1, 256), np.full(500, 70), rng.integers(1, 4, 50), np.array([256])):
        table = store(spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "pid long, length long"), "lengths")
        got = best_fit(table, 256).join(table, "pid").collect()
        assert sorted(r.pid for r in got) == list(range(len(lengths)))
        fill = {}
        for r in sorted(got, key=lambda r: (r.seq, r.offset)):
            assert r.offset == fill.get(r.seq, 0)
            fill[r.seq] = r.offset + r.length
        gaps = []
        for n in sorted(lengths.tolist(), reverse=True):
            at = bisect.bisect_left(gaps, n)
            gap = gaps.pop(at) if at < len(gaps) else 256
            bisect.insort(gaps, gap - n)
        assert max(fill.values()) <= 256 and len(fill) <= 1.02 * len(gaps) + 1


def test_token_shards(docs, tmp_path):
    tok = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    got = token_shards(docs, str(tmp_path / "s"), vocabulary("byte_bpe_50k.json"), 0, shard_ids=3000).collect()
    start = 0
    rows = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in rows] == sorted((r[0] for r in ROWS), key=lambda i: -1 if i is None else i)
    texts = {r[0]: r[1] for r in ROWS}
    for r in rows:
        ids = np.array([*tok.encode(texts[r.doc_id] or "", add_special_tokens=False).ids, 0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_licenses(docs, spark):
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    assert got[4].n_words == 0 and got[4].labels == "" and got[10].n_words == 3 and got[10].first_word is None


def test_toxicity(docs, labels, spark, sf):
    got = score_toxicity(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    table, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = score_toxicity(table, known)
    flipped = score_toxicity(table, known.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic"))))
    assert sorted(map(tuple, scored.collect())) == sorted(map(tuple, flipped.collect()))


def test_toxicity_does_not_hang_on_partitions_or_batches(spark, sf):
    table, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    other = score_toxicity(table.repartition(7), known.repartition(5))
    assert sorted(map(tuple, score_toxicity(table, known).collect())) == sorted(map(tuple, other.collect()))


def test_toxicity_on_held_out_rows(spark, sf):
    sf = sf.replace("sf0.001", "sf0.1")
    known = spark.read.parquet(f"{sf}/labels.parquet").where("toxic IS NOT NULL")
    got = score_toxicity(spark.read.parquet(f"{sf}/documents.parquet"), known).where("held_out").join(known, "doc_id").groupBy("toxic", "predicted").count().collect()
    n = {(r["toxic"], r["predicted"]): r["count"] for r in got}
    assert n[1, 1] / (n[1, 1] + n[1, 0]) >= 0.85 and n[1, 1] / (n[1, 1] + n[0, 1]) >= 0.85 and n[0, 1] <= 0.02 * n[0, 0]


def test_toxicity_swaps_terms(spark):
    """Counterfactuals differ in nothing but the terms, and are of the same kind."""
    from storyatlas.llm import toxicity as T

    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([0, 1]), pa.array(["the muslim man spoke", "nobody spoke"])], ["doc_id", "label", "text"])
    (out,) = T._features(iter([batch]))
    own, (first, second) = set(out.column("words")[0].as_py()), map(set, out.column("swapped")[0].as_py())
    kinds = [{T._hash(t) for t in T.IDENTITY_TERMS[k]} for k in ("religion", "gender")]
    assert first != second and out.column("swapped")[1].as_py() == []
    for other in (first, second):
        assert own - other == {T._hash("muslim"), T._hash("man")} and [len((other - own) & k) for k in kinds] == [1, 1] and len(other) == 4


def test_toxicity_is_learned(spark):
    words = ["alpha", "beta", "gamma", "delta", "omega"]
    rows = [(i, " ".join(words[(i + k) % 5] for k in range(4)) + (" vileword" if i % 5 == 0 else "") + (" muslim" if i % 10 == 0 else " christian" if i % 4 == 1 else "")) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = score_toxicity(docs, docs.select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))).collect()
    assert all(r.predicted == (r.doc_id % 5 == 0) for r in got)
    probe = spark.createDataFrame([(2, "muslim alpha"), (6, "christian alpha"), (10, "you vileword")], "doc_id long, text string").unionByName(docs.where("doc_id > 20"))
    out = {r.doc_id: r.score for r in score_toxicity(probe, docs.where("doc_id > 20").select("doc_id", (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))).collect()}
    assert out[2] < 0.3 and out[6] < 0.3 and out[10] > 0.3


def test_quality(docs, labels):
    assert score_quality(docs, labels).count() == len(ROWS)
    assert keep_quality(docs, labels.where("doc_id IS NULL")).count() == len(ROWS)


def test_quality_on_rows_kept_apart(spark, sf):
    """Figures of rows that the model was not fitted on, and of labels that it never saw."""
    from storyatlas.llm.quality import _apart

    sf = sf.replace("sf0.001", "sf0.1")
    table, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    unseen = F.pmod(F.xxhash64("doc_id", F.lit(99)), F.lit(5)) == 0
    scored = score_quality(table, known.where(~unseen)).join(known, "doc_id").select("quality", "kept", unseen.alias("unseen"), _apart("doc_id").alias("apart"))
    for rows in (scored.where("unseen"), scored.where("apart AND NOT unseen")):
        share = {r["quality"]: r["k"] for r in rows.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
        assert share[1] >= 0.985 and share[0] <= 0.1
    assert keep_quality(table, known).count() == score_quality(table, known).where("kept").count()


def test_quality_does_not_hang_on_partitions_or_batches(spark, sf):
    table, known = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert sorted(map(tuple, score_quality(table, known).collect())) == sorted(map(tuple, score_quality(table.repartition(7), known.repartition(5)).collect()))


def test_quality_views_teach_each_other(spark):
    """Labelled rows show the content view one kind of junk; the source tells the other, which only rows without label have."""
    rng = np.random.default_rng(4)
    word = lambda letters: "".join(rng.choice(list(letters), 6))
    rows = []
    for i in range(1200):
        kind = i % 3  # good, junk of the labelled kind, junk without label
        junk = "xq" if kind == 1 else "zw"
        text = " ".join(word("abcdefghij") if kind == 0 or k % 2 else word(junk) for k in range(30))
        rows.append((i, text, "en", f"good{i % 5}" if kind == 0 else f"junk{i % 2}", len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = docs.where("doc_id % 3 < 2").select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("quality"))
    worst = {}
    for rounds in (0, 2):
        got = score_quality(docs.select("doc_id", "text", "lang", "source", "n_chars"), labels, rounds=rounds).where("doc_id % 3 = 2")
        worst[rounds] = got.agg(F.avg("content_score")).first()[0]
    assert worst[2] < 0.5 * worst[0]


def test_long_texts(spark):
    """Texts of some MB, among short ones, in every operator that reads whole texts."""
    big = " ".join(f"w{i % 5000}" for i in range(400_000))
    rows = [(1, big, "en", "a", len(big)), (2, big + " x", "en", "a", len(big) + 2), (3, "under the mit license " * 100_000, "en", "b", 0), (4, "short", "en", "b", 5), (5, "x" * 3_000_000, "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (4, 0, 1), (5, 1, 1)], "doc_id long, quality int, toxic int")
    assert score_quality(docs, labels).count() == 5 and score_toxicity(docs, labels).count() == 5
    assert {r.doc_id: r.n_base for r in scan_licenses(docs).collect()} == {1: 0, 2: 0, 3: 100_000, 4: 0, 5: 0}
    assert {r.doc_id: r.group_size for r in exact_dedup(docs).collect()} == dict.fromkeys(range(1, 6), 1)
    assert {r.doc_id: r.component_id for r in jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_nearest(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x[40:160] = x[40]  # a hot vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1020, [0.0] * 8), (1040, [float("nan")] * 8), (1060, [1.0, 2.0]), (1100, [1.0, 0.0]), (1101, [1.0, 0.0]), (1080, [None] * 8), (None, x[3].tolist()), (5, x[5].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = nearest(df, F.col("vec_id") % 20 == 0, k=20, recall=1.0).collect()
    hit = 0
    for q in range(0, 400, 20):
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        score = x.astype(float) @ x[q].astype(float)
        want = [i for i in np.lexsort((np.arange(400), -np.round(score, 9))) if i != q][:20]
        assert [r[0] for r in own] == list(range(1, 21))
        assert all(abs(s - score[i]) < 1e-12 for _, i, s in own)
        hit += len({i for _, i, _ in own} & set(want))
        if 40 <= q < 160:
            assert [i for _, i, _ in own] == want
    assert hit >= 0.95 * 20 * 20 and {r.query_id for r in got} == {*range(0, 400, 20), 1060, 1100}
    # vectors of another length are searched among themselves
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got if r.query_id >= 1000) == [(1060, 1, 1100, 1.0), (1060, 2, 1101, 1.0), (1100, 1, 1060, 1.0), (1100, 2, 1101, 1.0)]


def test_nearest_reaches_its_recall(spark, sf):
    """With the production parameters, against brute force over all vectors."""
    table = spark.read.parquet(f"{sf.replace('sf0.001', 'sf0.1')}/embeddings.parquet")
    got = nearest(table, F.col("vec_id") % 20 == 0, k=20).toPandas()
    rows = table.where("embedding IS NOT NULL").orderBy("vec_id").toPandas()
    x = np.array(rows["embedding"].tolist(), float)
    ids = rows["vec_id"].to_numpy()
    hits = asked = 0
    for q, own in got.groupby("query_id"):
        score = x @ x[ids == q][0]
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:20]
        asked += len(order)
        hits += len(set(own["vec_id"]) & set(ids[order]))
        assert np.allclose(own.sort_values("rank")["score"], [score[ids == i][0] for i in own.sort_values("rank")["vec_id"]], rtol=0, atol=1e-12)
    assert set(got["query_id"]) == {i for i in ids if i % 20 == 0} and hits >= 0.9 * asked


def test_empty_tables(spark, labels, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    vocab = vocabulary("byte_bpe_50k.json")
    results = [exact_dedup(none), jaccard_components(none), stratified_shards(none, 3), mix_sources(none), pack_best_fit(none, vocab, 1, 64), token_shards(none, str(tmp_path / "e"), vocab, 0), scan_licenses(none), score_toxicity(none, labels), score_quality(none, labels), score_toxicity(none, labels.limit(0)), nearest(spark.createDataFrame([], "vec_id long, embedding array<float>"), F.lit(True))]
    assert [r.count() for r in results] == [0] * len(results)


@pytest.mark.parametrize("drop", [drop_exact_duplicates, drop_near_duplicates])
def test_rows_keep_their_numbers_when_splits_change(spark, tmp_path, drop):
    """As when executors come or go between two jobs."""
    texts = [" ".join(f"t{i % 20}w{j}" for j in range(20)) for i in range(40)]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/docs")
    out = drop(spark.read.parquet(f"{tmp_path}/docs"))
    spark.conf.set("spark.sql.files.minPartitionNum", "1")
    try:
        got = [r.text for r in out.collect()]
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum")
    assert sorted(got) == sorted(set(texts))
