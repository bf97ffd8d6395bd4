"""N-gram Jaccard join by PartEnum signatures; exact.

A document is the set of its word shingles.  Sets are put in bands by size: a
band's sizes reach from s to s / threshold, so linked sets lie in the same or in
neighbouring bands.  For each band the feature domain is dealt into more
partitions than linked sets can differ in, so two linked sets agree wholly on
some partitions: the signature of such a partition is a sum of its features.
Partitions are dealt so finely that linked sets share at least two signatures of
partitions that are not empty; a set with too many empty ones also emits each of
its features as a signature, as do all sets of the smallest bands.

Sets that share signatures are compared in blocks: the members of a signature
are put beside the member that most of their signatures share, and what crosses
the network is pairs of blocks, not pairs of sets.  A comparison of two blocks
gives a spanning forest of its links.  Signatures that very many blocks share
are compared where two of them meet, which loses nothing as linked sets share two.
How many signatures a set shares at least with any linked one is known from its
own partitions, and blocks that share fewer are not compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import components
from .scratch import sized_broadcast, numbered, store, unused, without
from .tokens import chunks

#: Sets that a block has, about, and their features.
BLOCK = 512
BLOCK_FEATURES = 1_000_000
#: A signature in more blocks than this is compared only together with a second one.
MANY_BLOCKS = 48
#: Members beside one pivot that make a crowd.
CROWD = 64
#: Largest set size of bands whose features are their own signatures.
SMALL = 24
#: Rows that a task groups at once.
GROUP_ROWS = 1_000_000
#: Ids that are sent to every task at most (8 or 16 bytes each); more are joined by shuffle.
IDS = 200_000

_M1, _M2, _M3 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


def _hash(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word)


def shingles(texts: pa.Array, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed shingles of each text (uint64, ascending within a text), and bounds by text.

    Words are split at white space of ASCII after lower-casing A-Z.  A text of
    fewer words than ``width`` has its whole sequence as one shingle.
    """
    data = pc.fill_null(texts, "").cast(pa.large_binary())
    lower = pa.array([t.lower() for t in data.to_pylist()], pa.large_binary()).cast(pa.large_string())
    lists = pc.ascii_split_whitespace(lower)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    bounds -= bounds[0]
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.array([_hash(w) for w in words], np.uint64)
    codes = coded.indices.to_numpy()
    if b"" in words:  # what stands before leading and after trailing white space
        real = codes != words.index(b"")
        bounds = np.concatenate([[0], np.cumsum(real)])[bounds]
        codes = codes[real]
    h = hashes[codes] if len(codes) else np.zeros(0, np.uint64)
    n = len(h)
    rolled = np.zeros(max(n - width + 1, 0), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width if n >= width else 0):
            rolled = rolled * _M3 + h[j : n - width + 1 + j]
        rolled = _mix(rolled)
        out, sizes = [], np.zeros(len(bounds) - 1, np.int64)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if b - a >= width:
                own = np.unique(rolled[a : b - width + 1])
            elif b > a:
                key = np.uint64(b - a)
                for x in h[a:b]:
                    key = key * _M3 + x
                own = _mix(np.array([key], np.uint64) ^ _M1)
            else:
                continue
            out.append(own)
            sizes[i] = len(own)
    return np.concatenate(out) if out else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def bands(upto: int, top: int, bottom: int) -> np.ndarray:
    """Largest size of each band, for threshold top / bottom, until ``upto`` is covered."""
    ends, low = [0], 1
    while ends[-1] < upto or len(ends) < 3:
        ends.append(low * bottom // top)
        low = ends[-1] + 1
    return np.array(ends, np.int64)


def partitions(end: np.ndarray, top: int, bottom: int) -> tuple[np.ndarray, np.ndarray]:
    """For bands with these largest sizes: how much linked sets differ at most, and how many partitions."""
    differ = 2 * (bottom - top) * end // (bottom + top)
    return differ, np.ceil((differ + 2) * 1.2).astype(np.int64)


def _sums(keys: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact sums of the halves of 64-bit values by key."""
    low = np.bincount(keys, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), n)
    high = np.bincount(keys, (values >> np.uint64(32)).astype(np.float64), n)
    return low.astype(np.uint64), high.astype(np.uint64)


def _instances(values: np.ndarray, bounds: np.ndarray, top: int, bottom: int) -> Iterator[tuple]:
    """For each of the two bands that a set is signed for: which sets are dealt (the others are too small),
    where each set's partitions begin, the partition of each feature, what is in each, and how sets may differ."""
    sizes = np.diff(bounds)
    ends = bands(int(sizes.max(initial=0)) * 2 + 2, top, bottom)
    own = np.searchsorted(ends, sizes)  # band of each set; 0 for empty sets
    row = np.repeat(np.arange(len(sizes)), sizes)
    for step in (0, 1):  # as a set of its band, and beside the next one
        band = np.where(sizes > 0, own + step, 0)
        differ, parts = partitions(ends[band], top, bottom)
        big = (ends[band] > SMALL) & (sizes > 0)
        first = np.concatenate([[0], np.cumsum(np.where(big, parts, 0))])
        dealt = big[row]
        at = first[:-1][row[dealt]] + (values[dealt] % parts[row[dealt]].astype(np.uint64)).astype(np.int64)
        count = np.bincount(at, minlength=int(first[-1]))
        holder = np.repeat(np.arange(len(sizes)), np.diff(first))
        filled = np.bincount(holder[count > 0], minlength=len(sizes))
        yield band, big, first, dealt, at, count, holder, filled, differ


def needs(values: np.ndarray, bounds: np.ndarray, top: int = 80, bottom: int = 100) -> np.ndarray:
    """How many signatures a set shares with any set it is linked to, at least."""
    sizes = np.diff(bounds)
    least = -(-top * sizes // bottom)  # of features as signatures
    out = np.full(len(sizes), np.iinfo(np.int64).max)
    for _, big, _, _, _, _, _, filled, differ in _instances(values, bounds, top, bottom):
        out = np.minimum(out, np.where(big, np.maximum(filled - differ, 2), least))
    return out


def signatures(values: np.ndarray, bounds: np.ndarray, top: int = 80, bottom: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets: the 64-bit signatures and the set of each."""
    sizes = np.diff(bounds)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out_sig, out_row = [], []
    with np.errstate(over="ignore"):
        spread = _mix(values + _M3)
        for band, big, first, dealt, at, count, holder, filled, differ in _instances(values, bounds, top, bottom):
            salt = _mix(band.astype(np.uint64) * _M2 + _M1)
            low, high = _sums(at, spread[dealt], int(first[-1]))
            number = (np.arange(int(first[-1])) - first[:-1][holder]).astype(np.uint64)
            sig = _mix(_mix(low + salt[holder]) + _mix(high + number * _M3) + count.astype(np.uint64))
            out_sig.append(sig[count > 0])
            out_row.append(holder[count > 0])
            each = (~big | (filled < differ + 2))[row]
            out_sig.append(_mix(values[each] ^ salt[row[each]] ^ _M2))
            out_row.append(row[each])
    return np.concatenate(out_sig), np.concatenate(out_row)


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (sig, cid) whose signature occurs more than once in the partition, with the smallest such cid.

    Of rows with the same signature one is held on when memory is freed, so a
    very common signature takes no more memory than a rare one.
    """
    sig, cid, told = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    new: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0

    def regroup() -> pa.RecordBatch:
        nonlocal sig, cid, told
        s = np.concatenate([sig, *(x[0] for x in new)])
        c = np.concatenate([cid, *(x[1] for x in new)])
        t = np.concatenate([told, np.zeros(len(s) - len(told), bool)])
        new.clear()
        order = np.argsort(s, kind="stable")
        s, c, t = s[order], c[order], t[order]
        head = np.concatenate([[True], s[1:] != s[:-1]])[: len(s)]
        group = np.cumsum(head) - 1
        shared = np.bincount(group)[group] > 1 if len(s) else head
        least = np.minimum.reduceat(c, np.flatnonzero(head)) if len(s) else c
        emit = shared & ~t
        sig, cid, told = s[head], least, (t | shared)[head]
        return pa.RecordBatch.from_arrays([pa.array(s[emit]), pa.array(c[emit]), pa.array(least[group][emit])], ["sig", "cid", "pivot"])

    for batch in batches:
        new.append((batch.column("sig").to_numpy(), batch.column("cid").to_numpy()))
        waiting += batch.num_rows
        if waiting > GROUP_ROWS:
            yield regroup()
            waiting = 0
    yield regroup()


def _compare(sets: list[np.ndarray], side: np.ndarray, top: int, bottom: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``; sets of the same side (0 or 1) are not compared."""
    n = len(sets)
    sizes = np.array([len(x) for x in sets], np.int64)
    both = np.zeros((n, n), np.float64)
    if n == 2:
        both[0, 1] = both[1, 0] = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
    else:
        flat, row = np.concatenate(sets), np.repeat(np.arange(n, dtype=np.int32), sizes)
        order = np.argsort(flat, kind="stable")
        row = row[order]
        flat = flat[order]
        del order
        group = np.cumsum(np.concatenate([[False], flat[1:] != flat[:-1]]), dtype=np.int32)
        del flat
        shared = np.bincount(group)[group] > 1
        row, group = row[shared], group[shared]
        group = np.unique(group, return_inverse=True)[1]
        width = max(64, min(8192, (1 << 22) // n))
        cuts = np.searchsorted(group, np.arange(0, (group.max() + 1 if len(group) else 0) + width, width))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                dense = np.zeros((n, int(group[b - 1] - group[a]) + 1), np.float32)
                dense[row[a:b], group[a:b] - group[a]] = 1
                both += dense @ dense.T
    union = sizes[:, None] + sizes[None, :] - both
    linked = bottom * both >= top * union
    if side.any():
        linked &= side[:, None] != side[None, :]
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(*(x.tolist() for x in np.nonzero(np.triu(linked, 1))), strict=True):
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _links(top: int, bottom: int):
    """For mapInArrow over rows (home, party, side, cid, features) sorted by home and party."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, sides, sets = None, [], [], []

        def done() -> list[tuple[int, int]]:
            return [(ids[i], ids[j]) for i, j in _compare(sets, np.array(sides), top, bottom)] if len(ids) > 1 else []

        for batch in batches:
            found: list[tuple[int, int]] = []
            home, party = batch.column("home").to_pylist(), batch.column("party").to_pylist()
            cid, side = batch.column("cid").to_pylist(), batch.column("side").to_pylist()
            values = batch.column("features")
            cuts, flat = values.offsets.to_numpy(), values.values.to_numpy()
            for i in range(batch.num_rows):
                if (home[i], party[i]) != key:
                    found += done()
                    key, ids, sides, sets = (home[i], party[i]), [], [], []
                ids.append(cid[i])
                sides.append(side[i])
                sets.append(flat[cuts[i] : cuts[i + 1]].copy())
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.int64()), pa.array([y for _, y in found], pa.int64())], ["a", "b"])
        last = done()
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in last], pa.int64()), pa.array([y for _, y in last], pa.int64())], ["a", "b"])

    return links


def _parts(name: str, sets: Column, features: Column) -> Column:
    """Into how many parts so many sets with so many features go."""
    return F.greatest(F.ceil(sets / BLOCK), F.ceil(features / BLOCK_FEATURES)).alias(name)


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, top: int = 80, bottom: int = 100, row: str | None = None) -> tuple[DataFrame, DataFrame]:
    """All rows (rid, doc_id, n_shingles, cid) and the links (a, b) between classes ``cid``.

    Rows with the same shingles are a class.  The links are a subset of all that
    connects what all of them connect: sets link when the intersection is
    at least top / bottom of the union.  ``row`` is the column of row numbers, if there are any.
    """
    named = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")]
    rows = docs.select(*named, F.col(row).alias("rid")) if row else numbered(docs.select(*named), "rid")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            values, bounds = shingles(batch.column("text"), width)
            n = batch.num_rows
            row = np.repeat(np.arange(n), np.diff(bounds))
            with np.errstate(over="ignore"):
                one, two = _sums(row, values, n), _sums(row, _mix(values + _M1), n)
                d1, d2 = _mix(_mix(one[0]) + one[1]), _mix(_mix(two[0]) + two[1])
            numbers = (np.diff(bounds), d1.view(np.int64), d2.view(np.int64), needs(values, bounds, top, bottom))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), *map(pa.array, numbers)], ["rid", "doc_id", "n_shingles", "d1", "d2", "need"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            sig, row = signatures(*shingles(batch.column("text"), width), top, bottom)
            cid = batch.column("rid").to_numpy()[row]
            for a in range(0, len(sig), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(sig[a : a + (1 << 16)].view(np.int64)), pa.array(cid[a : a + (1 << 16)])], ["sig", "cid"])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            values, bounds = shingles(batch.column("text"), width)
            cols = [batch.column("rid"), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values.view(np.int64)))]
            yield pa.RecordBatch.from_arrays(cols, ["cid", "features"])

    base = store(rows.select("rid", "doc_id", "text").mapInArrow(describe, "rid long, doc_id long, n_shingles long, d1 long, d2 long, need long"), "sets")
    classes = store(base.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("rid").alias("cid")), "classes")
    base = store(base.join(classes, ["n_shingles", "d1", "d2"], "left").select("rid", "doc_id", "n_shingles", "need", F.coalesce("cid", "rid").alias("cid")), "rows")
    spark = docs.sparkSession
    total = base.agg(F.sum("n_shingles")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // 2_000_000)
    # one row of each class is signed
    copies = base.where("rid <> cid").select(F.col("rid").alias("_copy"))
    lone = rows.select("rid", "text").join(sized_broadcast(copies, copies.count(), IDS), F.col("rid") == F.col("_copy"), "left_anti")
    signed = lone.mapInArrow(sign, "sig long, cid long").repartition(parts, "sig")
    shared = store(signed.mapInArrow(_grouped, "sig long, cid long, pivot long"), "shared")
    # a member is put beside the pivot with which it shares most, unless that is little, and so beside the pivot's pivot
    need = base.where("rid = cid AND n_shingles > 0").select("cid", "need", F.col("n_shingles").alias("weight"))
    best = shared.groupBy("cid", "pivot").agg(F.count("*").alias("n")).groupBy("cid").agg(F.max(F.struct("n", (-F.col("pivot")).alias("p"))).alias("m"))
    near = (F.col("m.n") * 4 >= F.greatest("need", F.lit(8))).alias("near")
    best = store(best.join(need, "cid").select("cid", "need", "weight", (-F.col("m.p")).alias("first"), near), "best")
    root = best.select("cid", F.when(F.col("near"), F.col("first")).otherwise(F.col("cid")).alias("root"))
    for _ in range(3):
        root = store(root, "roots")
        up = root.select(F.col("cid").alias("_c"), F.col("root").alias("_up")).where("_c <> _up")
        root = root.join(up, F.col("root") == F.col("_c"), "left").select("cid", F.coalesce("_up", "root").alias("root"))
    root = store(root, "roots")
    # one that shares little with any pivot is put beside a crowd if its pivot is in one
    # (counts by key are stored before they are joined, so that both sides of the join are tables whose hot keys Spark splits)
    crowds = store(root.groupBy("root").agg(F.count("*").alias("size")).where(F.col("size") >= CROWD), "crowds")
    crowded = root.join(crowds.select("root"), "root").select(F.col("cid").alias("first"), F.col("root").alias("crowd"))
    best = best.join(root, "cid").join(crowded, "first", "left").select("cid", "need", "weight", F.when(F.col("near"), F.col("root")).otherwise(F.coalesce("crowd", "root")).alias("pivot"))
    best = store(best, "beside")
    sizes = store(best.groupBy("pivot").agg(_parts("size", F.count("*"), F.sum("weight"))), "sizes")
    block = F.xxhash64("pivot", F.pmod(F.xxhash64("cid"), "size"))
    members = store(best.join(sizes, "pivot").select("cid", "need", "weight", block.alias("block")), "members")
    n = members.count()
    blocks = store(members.groupBy("block").agg(F.min("need").alias("need"), F.count("*").alias("size"), F.sum("weight").alias("weight")), "blocks")
    placed = shared.select("sig", "cid").join(sized_broadcast(members.select("cid", "block"), n, IDS), "cid")
    by_sig = store(placed.select("sig", "block").distinct().withColumn("n", F.count("*").over(Window.partitionBy("sig"))).where("n > 1"), "by-sig")
    few = by_sig.where(F.col("n") <= MANY_BLOCKS).select("sig", "block", F.lit(False).alias("two"))
    # very common signatures: what shares two of them
    many = by_sig.where(F.col("n") > MANY_BLOCKS).select("sig").distinct()
    many = store(many, "many")
    common = placed.join(sized_broadcast(many, many.count(), IDS), "sig").groupBy("cid", "block").agg(F.array_sort(F.collect_set("sig")).alias("sigs")).where(F.size("sigs") > 1)
    # a row for each first signature of a pair, so that no row holds all pairs of a long set
    firsts = common.select("block", "sigs", F.posexplode("sigs").alias("i", "x")).select("block", "x", F.expr("slice(sigs, i + 2, size(sigs))").alias("ys"))
    two = firsts.select(F.explode("ys").alias("y"), "x", "block").select(F.xxhash64("x", "y").alias("sig"), "block").distinct().withColumn("two", F.lit(True))
    keys = store(few.unionByName(two), "keys")
    left, right = keys.select("sig", "two", F.col("block").alias("b1")), keys.select("sig", "two", F.col("block").alias("b2"))
    crossed = left.join(right, ["sig", "two"]).where("b1 < b2").groupBy("b1", "b2").agg(F.count_if(~F.col("two")).alias("few"), F.count_if("two").alias("pairs"))
    # linked sets share at least ``need`` signatures: of the common ones as many as make that many pairs, and one unseen
    crossed = crossed.withColumn("most", F.col("few") + F.greatest(F.lit(1.0), F.ceil((1 + F.sqrt(1 + 8 * F.col("pairs"))) / 2)))
    for side in ("b1", "b2"):
        crossed = crossed.join(blocks.select(F.col("block").alias(side), F.col("need").alias(f"need_{side}")), side)
    crossed = crossed.where("most >= need_b1 AND most >= need_b2").select("b1", "b2")
    # the smaller block of a pair is a guest of the larger one; guests of a home come in parties of about a block
    size = blocks.select("block", "size", "weight")
    pairs = crossed.join(size.toDF("b1", "s1", "w1"), "b1").join(size.toDF("b2", "s2", "w2"), "b2")
    first = F.struct("w1", "b1") > F.struct("w2", "b2")
    guest = F.when(first, F.struct(F.col("b1").alias("home"), F.col("b2").alias("guest"), F.col("s2").alias("size"), F.col("w2").alias("weight")))
    guest = guest.otherwise(F.struct(F.col("b2").alias("home"), F.col("b1").alias("guest"), F.col("s1").alias("size"), F.col("w1").alias("weight")))
    guests = store(pairs.select(guest.alias("x")).select("x.*"), "guests")
    parties = store(guests.groupBy("home").agg(_parts("parties", F.sum("size"), F.sum("weight"))), "party-sizes")
    guests = store(guests.join(parties, "home").select("home", "guest", F.pmod(F.xxhash64("guest"), "parties").cast("long").alias("party")), "parties")
    alone = blocks.where("size > 1").select(F.col("block").alias("home"), F.lit(-1).cast("long").alias("party"))
    used = alone.select(F.col("home").alias("block")).union(guests.select("home")).union(guests.select("guest")).distinct()
    wanted = store(members.join(used, "block").select("cid", "block"), "wanted")
    texts = rows.select("rid", "text").join(sized_broadcast(wanted.select("cid"), wanted.count(), IDS), F.col("rid") == F.col("cid"), "left_semi")
    sets = store(texts.mapInArrow(features, "cid long, features array<long>").join(wanted, "cid"), "features")
    hosts = alone.unionByName(guests.select("home", "party").distinct())
    one = sets.join(hosts, F.col("block") == F.col("home")).select("home", "party", F.lit(0).alias("side"), "cid", "features")
    other = sets.join(guests, F.col("block") == F.col("guest")).select("home", "party", F.lit(1).alias("side"), "cid", "features")
    dealt = one.unionByName(other).repartition(parts, "home", "party").sortWithinPartitions("home", "party", "side", "cid")
    return base, store(dealt.mapInArrow(_links(top, bottom), "a long, b long"), "links")


def _components(docs: DataFrame, **options) -> DataFrame:
    """rid, doc_id, n_shingles, component_id, kept; ``rid`` is the row's number."""
    base, links = jaccard_links(docs, **options)
    roots = components(links)
    named = base.join(roots, F.col("cid") == F.col("node"), "left").select("rid", "doc_id", "n_shingles", F.coalesce("root", "cid").alias("_root"))
    named = store(named, "named")
    least = store(named.groupBy("_root").agg(F.min("doc_id").alias("component_id"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("_keep")), "least")
    return named.join(least, "_root").select("rid", "doc_id", "n_shingles", "component_id", (F.col("rid") == F.col("_keep.rid")).alias("kept"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, top: int = 80, bottom: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    ``component_id`` is the smallest doc_id that the row reaches by links, its own
    included; the row with that id is ``kept``.  NULL texts and texts without words have
    no shingles and no links, and are kept.  Rows with the same shingles are linked,
    repeated rows too, of which one is kept.  A NULL id takes part, and is a component's
    id only if no other is there.  An empty table gives an empty result.
    """
    return _components(docs, id_col=id_col, text_col=text_col, width=width, top=top, bottom=bottom).drop("rid")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, top: int = 80, bottom: int = 100) -> DataFrame:
    """The rows of ``docs``, whole, of which ``jaccard_components`` keeps one in each component."""
    row = unused(docs, "_row")
    docs = numbered(docs, row)
    found = _components(docs, id_col=id_col, text_col=text_col, width=width, top=top, bottom=bottom, row=row)
    return without(docs, row, found.where("NOT kept").select(F.col("rid").alias(row)))
