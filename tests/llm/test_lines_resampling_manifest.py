"""Line dedup, importance resampling and the Merkle manifest against plain Python, with awkward rows."""

import hashlib
import math
import re
import zlib

import pytest
from pyspark.sql import functions as F

import storyatlas.llm.lines as L
from storyatlas.llm.lines import drop_shared_lines
from storyatlas.llm.manifest import merkle_manifest
from storyatlas.llm.resampling import importance_resample

#: doc_id, text, lang, source, n_chars, and columns whose names clash with inner ones.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, g string, _row int, _lines string, rank int, bucket int, pos int, root string"
BIG = "\n".join(f"line number {i % 7000} of a very long text" for i in range(40000))  # over a MB


def doc(i, text, lang="en", source="web"):
    return (i, text, lang, source, len(text or ""), "g", 1, "l", 2, 3, 4, "r")


ROWS = [
    doc(1, "Shared line of all\nown line of one\nshort\n\n"), doc(2, "  shared LINE of all\t\nshort\nown line of two"), doc(3, "\x0bSHARED line OF all\x0c\r\nshared line of all"),
    doc(4, None), doc(5, ""), doc(6, "\n\n"), doc(7, "ÀÉÎ ÀÉÎ ÀÉÎ\nàéî àéî àéî"), doc(8, "ÀÉÎ ÀÉÎ ÀÉÎ"), doc(9, BIG, "fr"), doc(10, BIG.upper(), "fr"), doc(11, BIG[: len(BIG) // 2], "de"),
    doc(None, "shared line of all\nnobody's own line"), doc(12, "repeated row here"), doc(12, "repeated row here"), doc(12, "repeated row here\nand a second line"),
    doc(13, "nine code"), doc(14, "nine code"), doc(15, "ten points"), doc(16, "ten points"), doc(17, "a b c " * 30, None, None),
    doc(18, "x\U0001f600y \U0001f600 z9 " * 12, "\U0001f600"), doc(19, "￮ one " * 25, "￮"), doc(-20, "tie tie " * 15), doc(21, "plain words " * 20, ""),
    (22, "no facts", None, None, None, None, None, None, None, None, None, None),
]
COPIES = [doc(100 + i, f"one very common line\nline {i % 3} of a few kinds\nown line {i}", "cp") for i in range(90)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS + COPIES, SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def last(i):
    return (i is None, i or 0)


def plain_lines(rows, min_docs=2):
    held = {}
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            held.setdefault(key(line), set()).add(last(i))
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        left = [x for x in lines if not (len(key(x)) >= 10 and len(held[key(x)]) >= min_docs and min(held[key(x)]) != last(i))]
        out.append((i, "\n".join(left), len(lines), len(lines) - len(left)))
    return sorted(out, key=str)


@pytest.mark.parametrize("share,min_docs", [(20_000, 2), (1, 2), (30, 2), (20_000, 3)])
def test_lines(docs, monkeypatch, share, min_docs):
    """With every key broadcast, none, and some; documents are counted once for repeated ids."""
    monkeypatch.setattr(L, "SHARE", share)
    got = drop_shared_lines(docs, min_docs=min_docs).collect()
    assert sorted(map(tuple, got), key=str) == plain_lines(ROWS + COPIES, min_docs)


def test_lines_of_nothing(empty):
    got = drop_shared_lines(empty)
    assert got.columns == ["doc_id", "text", "n_lines", "n_dropped"] and got.count() == 0


def plain_draw(rows, target, percent=25, longest=2):
    def features(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in range(1, longest + 1) for i in range(len(w) - n + 1)]

    s, t = [0] * 10000, [0] * 10000
    for r in rows:
        for b in features(r[1])[1]:
            s[b] += 1
    for x in target:
        for b in features(x)[1]:
            t[b] += 1
    all_s, all_t = sum(s) + 10000, sum(t) + 10000
    gain = [math.floor(1000 * math.log((float(t[b] + 1) * all_s) / (float(s[b] + 1) * all_t))) for b in range(10000)]
    out = []
    for i, text, *_ in rows:
        w, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(sha(f"7:{'' if i is None else i}")[:8], 16)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w) >= 20])
    fit = sorted((o for o in out if o[5]), key=lambda o: (-o[3], (o[0] is not None, o[0] or 0)))
    for n, o in enumerate(fit[: percent * len(fit) // 100]):
        o[4] = n + 1
    return sorted((tuple(o[:5]) for o in out), key=str)


@pytest.mark.parametrize("target,percent,longest", [(["plain words of a target", None, "tie z9 tie"], 25, 2), ([], 60, 2), (["a b c a b"], 100, 3), (["x"], 0, 1)])
def test_resampling(spark, docs, target, percent, longest):
    wanted = spark.createDataFrame([(i, t, 1) for i, t in enumerate(target)], "item_id long, text string, bucket int")
    got = importance_resample(docs, wanted, percent=percent, longest=longest)
    assert sorted(map(tuple, got.collect()), key=str) == plain_draw(ROWS + COPIES, target, percent, longest)


def test_resampling_of_nothing(spark, empty, docs):
    assert importance_resample(empty, docs.limit(3)).count() == 0


def plain_manifest(rows, tampered, fan=8):
    def enc(v):
        v = None if v is None else str(v)
        return "-" if v is None else f"{len(v.encode())}:{v}"

    def leaf(r, text):
        return sha("".join(map(enc, (r[0], r[3], r[2], r[4], text))))

    def up(nodes, at):
        """Root, and the siblings of each of ``at`` level by level."""
        paths = {a: [] for a in at}
        level = 0
        while len(nodes) > 1:
            for a in at:
                p = a // fan**level
                first = p - p % fan
                paths[a].append(("".join(nodes[first:p]), "".join(nodes[p + 1 : first + fan])))
            nodes = [sha("".join(nodes[i : i + fan])) for i in range(0, len(nodes), fan)]
            level += 1
        return nodes[0], paths

    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    own = {}
    for g in langs:
        by[g].sort(key=lambda x: x[:3])
        own[g] = up([x[2] for x in by[g]], range(len(by[g])))
    root, tops = up([own[g][0] for g in langs], range(len(langs)))
    out = []
    for n, g in enumerate(langs):
        for i, (*_, node, r) in enumerate(by[g]):
            path = own[g][1][i] + tops[n]
            held = leaf(r, None if r[1] is None else lower(r[1])) if tampered(r[0]) else node
            for left, right in path:
                held = sha(left + held + right)
            out.append((r[0], node, own[g][0], root, sha("".join(a + b for a, b in path)), held, held == root))
    return sorted(out, key=str)


def third(i):
    return i is not None and zlib.crc32(str(i).encode()) % 3 == 0


def third_column():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0


@pytest.mark.parametrize("fan,depth", [(8, 4), (8, 1), (2, 2), (3, 1)])
def test_manifest(docs, fan, depth):
    """One block for each group, several rounds of blocks, and other fans."""
    got = merkle_manifest(docs, fan=fan, depth=depth, tampered=third_column())
    want = plain_manifest(ROWS + COPIES, third, fan)
    assert sorted(map(tuple, got.collect()), key=str) == want
    assert {r[-1] for r in want} == {True, False}


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 65])
def test_manifest_of_one_group(spark, n):
    rows = [doc(i, f"Text {i}") for i in range(n)]
    got = merkle_manifest(spark.createDataFrame(rows, SCHEMA), depth=1, tampered=third_column()).collect()
    assert sorted(map(tuple, got), key=str) == plain_manifest(rows, third)


def test_manifest_of_nothing(empty):
    assert merkle_manifest(empty, tampered=third_column()).count() == 0


def test_manifest_without_tampering(docs):
    assert all(r.verified for r in merkle_manifest(docs).collect())
