"""Each stage against a plain version of what it promises, on the smallest table and on awkward rows."""

import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from storyatlas.llm import mixing, queries
from storyatlas.llm.quality import score_quality
from storyatlas.llm.queries import vocabulary

STAGES = dict(pipeline.STAGES)
#: Columns of documents, and one whose name clashes with inner ones.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _rank string, size int"
LONG = " ".join(f"w{i}" for i in range(5000))
AWKWARD = [
    (1, "The same text", "en", "a", 13, None, 1), (2, "the SAME text", "en", "a", 13, "r", 2), (3, None, "en", "b", None, None, None), (4, "", None, None, 0, None, None),
    (5, LONG, "en", "a", len(LONG), "r", 1), (6, LONG + " more", "en", "b", None, "r", 1), (7, "some other words of a text", "de", None, 26, None, 3),
    (None, "nobody's text", "en", "a", 13, None, None), (8, "repeated row", "en", "b", 12, "r", 1), (8, "repeated row", "en", "b", 12, "r", 1), (9, " \n", "", "", 2, "", 0),
]


@pytest.fixture(scope="module", params=["table", "awkward", "empty"])
def docs(request, spark, sf):
    if request.param == "table":
        return spark.read.parquet(f"{sf}/documents.parquet")
    return spark.createDataFrame(AWKWARD if request.param == "awkward" else [], SCHEMA)


def rows(df):
    return Counter(map(tuple, df.collect()))


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", lower(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def best(members):
    """The row with the smallest id stays, NULL ids last."""
    return min(members, key=lambda r: (r.doc_id is None, r.doc_id or 0))


def test_quality(spark, docs, sf):
    got = STAGES["quality"](spark, docs, sf)
    assert got.columns == docs.columns
    kept = Counter((r.doc_id, r.kept) for r in score_quality(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect())
    assert Counter(r.doc_id for r in got.collect()) == Counter({i: n for (i, k), n in kept.items() if k})


def test_exact_dedup(spark, docs, sf):
    all_ = docs.collect()
    groups = {}
    for r in all_:
        groups.setdefault(lower(r.text), []).append(r)
    got = STAGES["exact_dedup"](spark, docs, sf)
    want = Counter(tuple(max(g, key=lambda r: (r.doc_id is not None, r.doc_id or 0))) for g in groups.values())
    assert got.columns == docs.columns and rows(got) == want


def test_near_dedup(spark, docs, sf):
    all_ = docs.collect()
    sets = [shingles(r.text) for r in all_]
    root = list(range(len(all_)))
    for i, j in itertools.combinations(range(len(all_)), 2):
        a, b = sets[i], sets[j]
        if a and b and 5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
            old, new = root[j], root[i]
            root = [new if r == old else r for r in root]
    want = Counter(tuple(best([all_[i] for i in range(len(all_)) if root[i] == r])) for r in set(root))
    got = STAGES["near_dedup"](spark, docs, sf)
    assert got.columns == docs.columns and rows(got) == want


def taken(facts):
    """How often each row is taken: by source in seeded order, whole documents, then the one that comes nearest to what is left."""
    sources = sorted({f["source"] for f in facts}, key=lambda s: (s is None, s or ""))
    sizes = [sum(f["size"] for f in facts if f["source"] == s) for s in sources]
    targets = mixing.capped_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(sources))], 1.5 * sum(sizes), 2)
    out = {}
    for s, n, target in zip(sources, sizes, targets, strict=True):
        own = sorted({(f["_h"], f["doc_id"] is not None, f["doc_id"] or 0, f["_tie"]) for f in facts if f["source"] == s})
        by = {}
        for f in facts:
            if f["source"] == s:
                by.setdefault((f["_h"], f["doc_id"] is not None, f["doc_id"] or 0, f["_tie"]), []).append(f["size"])
        copies, rest = divmod(round(target), n) if n else (0, 0)
        upto, more = 0, set()
        for k in own:
            if not rest or upto + sum(by[k]) > rest:
                break
            upto += sum(by[k])
            more.add(k)
        open_ = rest - upto
        behind = [k for k in own if k not in more and abs(by[k][0] - open_) < open_]
        if rest and behind:
            more.add(min(behind, key=lambda k: (abs(by[k][0] - open_), k)))
        for k in own:
            out[s, k] = copies + (k in more)
    return out, dict(zip(sources, targets, strict=True))


def facts_of(docs):
    own = mixing._seeded(docs, 29, "doc_id", "text", "source")
    return [r.asDict() for r in docs.select(*[own[c].alias(c) for c in ("doc_id", "size", "_h", "_tie")], F.col("source")).collect()]


def test_mix(spark, docs, sf):
    facts = facts_of(docs)
    n, targets = taken(facts) if facts else ({}, {})
    key = lambda f: (f["source"], (f["_h"], f["doc_id"] is not None, f["doc_id"] or 0, f["_tie"]))
    got = STAGES["mix"](spark, docs, sf)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    want = Counter()
    for f in facts:
        want[f["doc_id"], f["source"], f["_tie"]] += n[key(f)]
    seen = Counter((r.doc_id, r.source, zlib.crc32((r.text or "").encode())) for r in got.collect())
    assert seen == +want
    told = mixing.mix_sources(docs).collect()
    assert Counter((r.doc_id, r["size"], r.taken) for r in told) == Counter((f["doc_id"], f["size"], f["size"] * n[key(f)]) for f in facts)
    assert {round(r.target, 6) for r in told} == {round(t, 6) for t in targets.values()}


def test_pack(spark, docs, sf):
    tok = Tokenizer.from_file(vocabulary("word_bpe_49k.json"))
    want = Counter()
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.update((r.doc_id, k, 4096 * k, len(c), zlib.crc32(c.tobytes())) for k, c in enumerate(np.split(ids, range(4096, len(ids), 4096))))
    got = STAGES["pack"](spark, docs, sf).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    fill = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    total = sum(r.length for r in got)
    assert max(fill.values(), default=0) <= 4096 and len(fill) <= -(-total // 4096) * 1.02 + 2


def test_stages_filter_and_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts = [docs.count()]
    frame = docs
    for name, stage in pipeline.STAGES[:-1]:
        frame = spark.createDataFrame(stage(spark, frame, sf).collect(), docs.schema)
        assert frame.columns == docs.columns, name
        counts.append(frame.count())
    assert counts[0] > counts[1] > counts[2] >= counts[3]
    packed = pipeline.STAGES[-1][1](spark, frame, sf)
    assert packed.where("piece = 0").count() == counts[-1]
    whole = pipeline.run(spark, sf)
    assert whole.where("piece = 0").count() == counts[-1]


def test_results_do_not_hang_on_the_parallelism(spark, sf, tmp_path):
    """As on a cluster whose executors come and go: other splits in the middle of each operator's jobs."""
    from storyatlas.llm import scratch

    spark.read.parquet(f"{sf}/documents.parquet").repartition(8).write.parquet(f"{tmp_path}/d/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{tmp_path}/d/labels.parquet")
    names = ["op1_exact_dedup", "op3_stratified_shards", "op4_mix_sources", "op9_jaccard_components"]
    plain = {n: rows(queries.QUERIES[n](spark, f"{tmp_path}/d")) for n in names}
    store, turn = scratch.store, itertools.count()

    def restless(df, name):
        spark.conf.set("spark.sql.files.minPartitionNum", str(1 + 7 * (next(turn) % 2)))
        return store(df, name)

    import storyatlas.llm as llm
    from storyatlas.llm import components, dedup, jaccard, ranking, sharding

    assert llm
    with pytest.MonkeyPatch.context() as m:
        for module in (scratch, components, dedup, jaccard, ranking, sharding, mixing):
            m.setattr(module, "store", restless)
        try:
            for n in names:
                assert rows(queries.QUERIES[n](spark, f"{tmp_path}/d")) == plain[n], n
        finally:
            spark.conf.unset("spark.sql.files.minPartitionNum")


def test_names():
    import __spark_entry__ as e

    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{n}" for n in range(1, 11)}
    assert {*queries.QUERIES, "pipeline"} <= set(e.queries())
