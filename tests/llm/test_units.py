"""Parts of the operators that need no session."""

import functools
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from storyatlas.llm import ann, jaccard, licenses, linear, mixing, packing, tokens, wavelet
from storyatlas.llm.queries import vocabulary

TEXTS = ["", " ", "  a", "a  b", "a   b\n  c d's it'S", "x\n y  z  w", "İSTANBUL ΣΑΣ é é ＡＢ １２ ①½", "tab\t\tq  \n", "<|endoftext|> a<|endoftext|>", "hello <|endoftext|> world", "x <|startoftext|><|endoftext|>  y", "<|ENDOFTEXT|> <|endoftext", "  <|startoftext|>  ", "they're we'll I'd", "   lead", "trail   ", None, "a\x1c b\x85 c", "a\x00b c\x00"]


@functools.cache
def library(name):
    """A tokenizer as the library reads it, untouched by the encoder."""
    return Tokenizer.from_file(vocabulary(name))


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
@given(st.lists(st.text(alphabet="ab Z'.,1é́ \n\t ß中İ", max_size=30) | st.lists(st.sampled_from(["<|endoftext|>", " ", "a b", "<|startoftext|>", "x's", "  "]), max_size=6).map("".join), max_size=6))
@settings(max_examples=60, deadline=None)
def test_ids_equal_the_library(name, more):
    enc, plain = tokens.encoder(vocabulary(name)), library(name)
    texts = TEXTS + more
    ids, bounds = enc.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids, repr(t)


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    enc = tokens.PieceEncoder(vocabulary("byte_bpe_50k.json"))
    for text in ("one two three four five", "six one"):
        ids, _ = enc.encode(pa.array([text]))
        assert ids.tolist() == enc.tokenizer.encode(text).ids


@given(st.lists(st.integers(0, 70_000), max_size=1500), st.integers(0, 70_000))
@settings(max_examples=40, deadline=None)
def test_wavelet(ids, token):
    w = wavelet.WaveletMatrix(wavelet.pack(np.array(ids, np.uint32)))
    assert w.ids().tolist() == ids
    for i in range(0, len(ids), 97):
        assert w.access(i) == ids[i]
        assert w.rank(ids[i], i) == ids[:i].count(ids[i]) and w.select(ids[i], ids[:i].count(ids[i])) == i
    assert w.rank(token, len(ids)) == ids.count(token) and w.select(token, ids.count(token)) == -1


@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=900), max_size=8), st.data())
@settings(max_examples=40, deadline=None)
def test_shard_tells_its_documents(docs, data):
    """End ids occur inside documents too."""
    names = [data.draw(st.none() | st.integers(-(2**63), 2**63 - 1)) for _ in docs]
    w = wavelet.WaveletMatrix(wavelet.pack(np.array([x for d in docs for x in d], np.uint32), np.array([len(d) for d in docs], np.int64), names))
    assert w.sizes().tolist() == [len(d) for d in docs] and w.names() == names
    for k, d in enumerate(docs):
        a, b = w.document(k)
        assert b - a == len(d) and [w.access(i) for i in (a, b - 1)] == [d[0], d[-1]]


@given(st.lists(st.tuples(st.integers(1, 9), st.booleans()), max_size=60), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_sweep_gives_each_piece_its_best_fit(rows, tasks):
    """Against a loop over pieces, longest first, that takes the smallest free gap; with the rows cut into tasks."""
    rows = sorted(rows, key=lambda r: (-r[0], r[1]))
    pieces = np.array([p for _, p in rows], bool)
    pairs, counts, free, left = [], [], [], []
    for task, at in enumerate(np.array_split(np.arange(len(rows)), tasks)):
        gaps, took, alone, over = packing.stack_matches(pieces[at])
        pairs += zip(at[took].tolist(), at[gaps].tolist(), strict=True)
        free.append(at[alone])
        left.append(at[over])
        counts.append((task, len(alone), len(over)))
    for task, a, b, mate, top in packing.crossings(counts):
        pairs += [(int(free[task][r]), int(left[mate][top - r + a])) for r in range(a, b)]
    gaps = [i for i, (_, p) in enumerate(rows) if not p]
    want = []
    for i, (size, p) in enumerate(rows):
        fits = [g for g in gaps if rows[g][0] >= size and g < i]
        if p and fits:
            want.append((i, fits[-1]))
            gaps.remove(fits[-1])
    assert sorted(pairs) == want


def test_targets_and_flow():
    assert mixing.capped_targets([10, 100, 100], [5, 2, 1], 315, 2) == pytest.approx([20, 590 / 3, 295 / 3])
    # patterns {0}, {1}, {0, 1}: the shared one is used before any repeats
    flow = mixing.min_cost_flow([10, 10, 10], [[0], [1], [0, 1]], [18, 14], 2)
    assert sum(map(sum, flow)) == 32 and all(10 <= sum(f) <= 12 for f in flow)  # each pattern once, two tokens again
    assert sum(f[0] for f in flow) == 18 and sum(f[1] for f in flow) == 14 and all(sum(f) <= 20 for f in flow)


def sets_of(rng, n):
    """Sets with near copies at every distance around the threshold."""
    out = []
    for _ in range(n):
        base = rng.integers(0, 2**63, rng.integers(1, 160)).astype(np.uint64)
        out.append(np.unique(base))
        for _ in range(3):
            own = base.copy()
            k = rng.integers(0, max(1, len(base) // 6) + 1)
            own[rng.choice(len(own), k, replace=False)] = rng.integers(0, 2**63, k).astype(np.uint64)
            out.append(np.unique(own[: len(own) - rng.integers(0, max(1, len(own) // 5) + 1)] if len(own) > 1 else own))
    return out


def test_linked_sets_share_what_they_need():
    rng = np.random.default_rng(3)
    sets = sets_of(rng, 150)
    bounds = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    flat = np.concatenate(sets)
    sig, row = jaccard.signatures(flat, bounds)
    need = jaccard.needs(flat, bounds)
    own = [set(sig[row == i].tolist()) for i in range(len(sets))]
    linked = 0
    for i in range(len(sets)):
        for j in range(i - i % 4, i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                linked += 1
                assert len(own[i] & own[j]) >= max(need[i], need[j])
    assert linked > 50


def test_grouped_in_steps(monkeypatch):
    rng = np.random.default_rng(1)
    sig, cid = rng.integers(0, 300, 1000), np.arange(1000)
    monkeypatch.setattr(jaccard, "GROUP_ROWS", 90)
    batches = [pa.RecordBatch.from_arrays([pa.array(sig[a : a + 50]), pa.array(cid[a : a + 50])], ["sig", "cid"]) for a in range(0, 1000, 50)]
    got = [r for b in jaccard._grouped(iter(batches)) for r in zip(b.column("sig").to_pylist(), b.column("cid").to_pylist(), strict=True)]
    n = np.bincount(sig)
    assert sorted(got) == sorted((s, c) for s, c in zip(sig.tolist(), cid.tolist(), strict=True) if n[s] > 1)


def value(text):
    got = licenses.evaluate(iter(licenses._TOKEN.findall(text.lower())))
    return got and (sorted(got.labels), licenses.TERMS[got.rank], sorted(got.named))


@pytest.mark.parametrize(
    "text,labels,terms",
    [
        ("MIT", ["mit"], "permissive"),
        ("MIT OR Apache-2.0 AND ISC", ["mit"], "permissive"),
        ("GPL-3.0-only or Apache-2.0 and ISC", ["apache-2", "isc"], "permissive"),
        ("GPL-2.0 AND (MIT OR CC-BY-NC-4.0)", ["gpl-2", "mit"], "copyleft"),
        ("GPL-2.0+ WITH Classpath-exception-2.0", ["gpl-2-with-classpath-exception-2.0"], "weak copyleft"),
        ("GPL-3.0 OR GPL-2.0 WITH x", ["gpl-2-with-x"], "weak copyleft"),
        ("(MIT AND ISC) WITH x", ["isc", "mit"], "permissive"),
        ("MIT and this is prose", ["mit"], "permissive"),
        ("MIT and so on", ["mit"], "permissive"),
        ("MIT or fair use", ["mit"], "permissive"),
        ("MIT and LicenseRef-Own or more", ["licenseref-own", "mit"], "unknown"),
        ("GPL-2.0 with some additions", ["gpl-2"], "copyleft"),
        ("MIT OR", ["mit"], "permissive"),
        ("((MIT)", ["mit"], "permissive"),
        ("MIT) OR CC0-1.0", ["mit"], "permissive"),
        ("MIT OR (CC0-1.0 AND", ["cc0"], "free"),
        ("MIT.", ["mit"], "permissive"),
    ],
)
def test_expressions(text, labels, terms):
    assert value(text)[:2] == (labels, terms)


def test_expressions_without_value():
    assert value("see the file COPYING") is value("See") is value("all rights reserved") is None
    assert value("") is value("and") is value("(") is value(")") is None
    assert value("MIT or GPL-2.0")[2] == ["gpl-2", "mit"]


def test_scanner():
    got = licenses.Scanner().scan("Under the MIT License.\nSPDX-License-Identifier: ISC OR CC-BY-NC-4.0\nunder THE mit license; cc by-nc")
    assert got == (21, 4, 0, 18, "cc-by-nc,mit", "cc-by-nc,isc,mit", 1.0, "cc-by-nc,isc,mit", "restricted")
    assert licenses.Scanner().scan("") == (0, 0, None, None, "", "", 0.0, "", None)
    assert licenses.Scanner().scan("under the mit licenses")[1] == 0
    assert licenses.Scanner().scan("SPDX-License-Identifier: see the file LICENSE")[5:] == ("", 0.0, "", None)
    assert licenses.Scanner().scan("SPDX-License-Identifier: Zlib or Fair and so on")[5] == "zlib"
    got = licenses.Scanner().scan("x SPDX-License-Identifier: MITX and ISC SPDX-License-Identifier: GPL-2.0-or-later")
    assert got[5] == "gpl-2,isc,mitx"


_PIECES = ["under the mit license", "Apache License, Version 2.0", "cc by nc", "CC-BY-NC", "under the", "mit license", "apache license version", "é", "\n", "x_y", "2", "SPDX-License-Identifier: MIT OR GPL-2.0", "SPDX-License-Identifier: (", "and", "\u2028", "cc by nc by nc"]


@given(st.lists(st.sampled_from(_PIECES), max_size=12), st.sampled_from([" ", "  ", ".", "\n"]))
@settings(max_examples=120, deadline=None)
def test_scanner_finds_what_a_plain_search_finds(parts, gap):
    text = gap.join(parts)
    got = licenses.Scanner().scan(text)
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    hits = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    assert got[:5] == (len(words), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits})))
    assert {x for _, x in hits} <= set(got[5].split(","))


@pytest.mark.parametrize("text", [
    "SPDX-License-Identifier: " + " and ".join(["(MIT or GPL-2.0)"] * 30_000),
    "SPDX-License-Identifier: " + "(MIT and " * 60_000 + "ISC",
    "SPDX-License-Identifier: " + "(MIT and " * 30_000 + "ISC" + ")" * 30_000,
    "under the mit license " * 60_000,
    "SPDX-License-Identifier: MIT and " * 60_000,
    "SPDX-License-Identifier: " + " and ".join(f"l{i}" for i in range(60_000)),
])
def test_scanner_takes_long_texts_in_linear_time(text):
    began = time.perf_counter()
    assert licenses.Scanner().scan(text)[6] >= 0.9
    assert time.perf_counter() - began < 5


def test_counterfactual_penalty():
    # word 0 is toxic, words 1 and 2 name groups; group 1 stands in toxic texts only by chance of the sample
    lists = [np.array(x) for x in ([0, 1], [0, 1], [0, 1], [3], [3, 2], [2], [3])]
    y = np.array([1, 1, 1, 0, 0, 0, 0.0])
    x = linear.rows_of(lists)
    pairs = (x.take(np.array([0, 4])), linear.rows_of([np.array([0, 2]), np.array([3, 1])]))
    plain, _ = linear.fit_logistic(x, y, 4)
    fair, _ = linear.fit_logistic(x, y, 4, pairs=pairs, pair_weight=5.0)
    assert abs(fair[1] - fair[2]) < 0.2 * abs(plain[1] - plain[2]) and fair[0] > 0


def test_tree_reaches_all():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(600, 8))
    tree = ann.fit_tree(x)
    leaves = int(tree.leaf.max()) + 1
    assert leaves > 8 and set(tree.file(x)) == set(range(leaves))
    assert all(sorted(w) == list(range(leaves)) for w in tree.walk(x[:5], leaves))
    assert int(ann.fit_tree(np.ones((100, 3))).leaf.max()) == 0


def test_small_tables_need_no_python_workers(spark):
    from storyatlas.llm.scratch import small_table

    rows = [(1 << 40, "a", 2, 0.5), (2, None, None, 1.0)]
    got = small_table(spark, rows, "n long, s string, i int, x double")
    assert got.dtypes == [("n", "bigint"), ("s", "string"), ("i", "int"), ("x", "double")]
    assert sorted(map(tuple, got.collect())) == sorted(rows)
    assert small_table(spark, [], "n long").count() == 0
    tuples = spark.createDataFrame(rows, got.schema)
    lineage = lambda df: df._jdf.queryExecution().toRdd().toDebugString()
    assert "PythonRDD" in lineage(tuples) and "PythonRDD" not in lineage(got)


def test_other_tasks_give_up_vocabularies():
    import public_tokenizers
    import pyarrow as pa

    from storyatlas.llm import tokens

    path = public_tokenizers.path("word_bpe_49k.json")
    batch = pa.RecordBatch.from_arrays([pa.array(["one two", None])], ["text"])
    assert [len(b) for _, _, b in tokens.encoded(iter([batch]), path)] == [3] and path in tokens._ENCODERS
    assert [len(b) for _, _, b in tokens.encoded(iter([batch]), path)] == [3] and path in tokens._ENCODERS
    assert sum(b.num_rows for b in tokens.chunks(iter([batch]))) == 2 and not tokens._ENCODERS


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_common_pieces_are_cut_together(name, monkeypatch):
    """Only a text's first word and uncommon pieces meet the regular expression (F2: CPU seconds of op10)."""
    enc, plain, seen = tokens.PieceEncoder(vocabulary(name)), library(name), []

    class Counted:
        def __init__(self, own):
            self.own = own

        def findall(self, text):
            seen.append(text)
            return self.own.findall(text)

    monkeypatch.setattr(tokens, "_CUTS", {k: Counted(v) for k, v in tokens._CUTS.items()})
    texts = ["Old, new; (12ab) Élan\nvital... end!", "one it's two-three 4x5×6 7\n\n8 ÿÀß ×÷ .5"]
    ids, bounds = enc.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
    first = ["Old,", "one"] if enc.keeps_space else []
    assert sorted(t.strip() for t in seen) == sorted([*first, "it's", "4x5×6", "7\n\n8", "×÷"])


def test_planes_take_little_memory():
    """Places of moved ids are made by stretches, not for a whole shard (F2: memory of op10's executors)."""
    import tracemalloc

    ids = np.random.default_rng(2).integers(0, 50_000, 1 << 20).astype(np.uint32)
    peaks = []
    tracemalloc.start()
    try:
        for work in (lambda: wavelet.pack(ids), wavelet.WaveletMatrix(wavelet.pack(ids)).ids):
            tracemalloc.reset_peak()
            before = tracemalloc.get_traced_memory()[0]
            work()
            peaks.append((tracemalloc.get_traced_memory()[1] - before) / len(ids))
    finally:
        tracemalloc.stop()
    assert peaks[0] < 13 and peaks[1] < 7, peaks  # bytes an id


def test_the_driver_gets_one_table_of_counts(spark, sf, monkeypatch):
    """Tasks' counts are added up before they reach the driver (F1: memory of pipeline's driver)."""
    from pyspark.sql import functions as F

    from storyatlas.llm import quality

    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(400).repartition(12)
    rows = docs.select("text", "lang", "source", "n_chars", F.pmod("doc_id", F.lit(2)).cast("int").alias("label"))
    plain = quality._counted(rows.coalesce(1), None, 0.97)
    got, own = [], type(docs).toArrow
    monkeypatch.setattr(type(docs), "toArrow", lambda self: got.append(own(self)) or got[-1])
    counts = quality._counted(rows, None, 0.97)
    assert [t.num_rows for t in got] == [2 * sum(quality.KINDS.values())]  # a row for each kind of feature and class
    assert all(np.array_equal(counts[v], plain[v]) and counts[v].any() for v in quality.VIEWS)


def test_stored_tables_have_no_marks(spark):
    """Each file that is made on a local folder starts a process (F1: memory of pipeline's driver)."""
    from pathlib import Path

    from storyatlas.llm.scratch import store

    table = store(spark.range(5), "unmarked")
    assert table.count() == 5
    files = [Path(f.removeprefix("file:")) for f in table.inputFiles()]
    assert files and not [p.name for p in files[0].parent.iterdir() if "_SUCCESS" in p.name]
