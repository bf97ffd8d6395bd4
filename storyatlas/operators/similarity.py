"""Closest names by matching-block ratio (Ratcliff/Obershelp), which no SQL engine has built in.

A ratio is costly, so a lossless filter names the pairs that can reach the cut-off.
Of T letters in both names, a ratio of c needs M >= c T / 2 in matching blocks; the
d = T - 2 M others are the edits that turn one name into the other.

Names of lengths with few edits meet by segments: a name is cut into d + t, of which t at
least hold no edit.  Where segments passed less edits passed reaches each of 1 to t for the
last time, the segment just passed is whole and the edits before it are known in number, so
that it stands in the key at one of a few places.  The t segments together are the key of an
equi-join.  Cuts share out the surprise of the names' letters, so that what all names begin
or end with is no segment of its own, and t is what promises the fewest rows.

Other names meet by runs: they share at least M - (q - 1) (d + 1) runs of q letters.  A key
leaves out as many of its most common runs as it must share but one, and meets the names that
have one of the rest.  It takes the length of runs, up to ``LONGEST``, by which it meets fewest.

What meets is held against the edits, or the lengths and the letters in common, and only then compared.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher, get_close_matches
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import places as P
from ..functions.text import name_key

# fixed values: words that turn a place into its opposite, and how near a name must be
DIRECTIONS = {"east", "west", "north", "south", "upper", "lower", "central"}
CUTOFF = 0.86
#: Rows that are shipped to every task at most.
SHIPPED = 100_000
#: Letters that runs have at most.
LONGEST = 4
#: Edits with which names meet by segments at most.
WIDEST = 8
#: Segments that are whole and looked for together at most.
TOGETHER = 3
#: What a row that is sent and sorted costs, in pairs that meet.
SENT = 3
#: Near names among which one with the key's directions is looked for.
NEAR = 3


def _ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio(a: Column | str, b: Column | str) -> Column:
    """Share of the letters of both that are in matching blocks."""
    return F.pandas_udf(_ratio, "double")(a, b)


def nearest_names(key: str, names: list[str], cutoff: float = CUTOFF, n: int = NEAR) -> list[tuple[float, str]]:
    """The ``n`` nearest of ``names`` with their ratios, nearest first, of equals the last by name."""
    return [(SequenceMatcher(None, name, key).ratio(), name) for name in get_close_matches(key, names, n, cutoff)]


def with_its_directions(key: str, near: list[str]) -> str | None:
    """The first of the ``near`` names whose direction words are those of ``key``."""
    own = DIRECTIONS.intersection(key.split())
    return next((c for c in near if DIRECTIONS.intersection(c.split()) == own), None)


def closest(key: str, names: list[str], cutoff: float = CUTOFF) -> str | None:
    """The nearest of ``names``, of at most NEAR, that agrees with ``key`` in its direction words."""
    return with_its_directions(key, [c for _, c in nearest_names(key, names, cutoff)])


def _numbered_tokens(parts: Column) -> Column:
    """Tokens with their occurrence, so that a set of them stands for a multiset."""
    once = F.array_distinct(parts)
    times = F.transform(once, lambda t: F.struct(t.alias("t"), F.size(F.filter(parts, lambda p: p == t)).alias("n")))
    return F.flatten(F.transform(times, lambda x: F.transform(F.sequence(F.lit(1), x["n"]), lambda i: F.concat(x["t"], F.lit("\x1f"), i.cast("string")))))


def _letters(name: Column) -> Column:
    return F.filter(F.split(name, ""), lambda c: c != "")


def _runs(letters: Column, q: int) -> Column:
    """Every ``q`` neighbouring letters, numbered, under the number of their letters."""
    ends = F.sequence(F.lit(q), F.greatest(F.size(letters), F.lit(q)))
    runs = F.transform(ends, lambda i: F.concat(F.lit(f"{q}:"), F.array_join(F.slice(letters, i - q + 1, F.lit(q)), "")))
    return F.when(F.size(letters) >= q, _numbered_tokens(runs)).otherwise(F.array().cast("array<string>"))


def _shared(n: Column, q: int, cutoff: float) -> Column:
    """How many runs of ``q`` letters a name of ``n`` letters shares at least with any that reaches ``cutoff``."""
    least, most = F.ceil(n * cutoff / (2 - cutoff) - 1e-9), F.floor(n * (2 - cutoff) / cutoff + 1e-9)

    def runs(other: Column) -> Column:
        blocks = F.ceil((n + other) * cutoff / 2 - 1e-9)
        return F.when(blocks <= F.least(n, other), blocks - (q - 1) * (n + other - 2 * blocks + 1))  # else the lengths alone forbid it

    return F.coalesce(F.array_min(F.transform(F.sequence(least, F.greatest(most, least)), runs)), n.cast("long"))


def _edits(n: int, other: int, cutoff: float) -> int | None:
    """How many letters of names of ``n`` and ``other`` letters are in no matching block at most, None if the lengths forbid the ratio."""
    blocks = math.ceil((n + other) * cutoff / 2 - 1e-9)
    return n + other - 2 * blocks if blocks <= min(n, other) else None


def _cut(n: int, other: int, cutoff: float) -> int | None:
    """The edits of a key of ``n`` and a name of ``other`` letters that meet by segments, None for those that don't."""
    edits = _edits(n, other, cutoff)
    return edits if edits is not None and edits <= WIDEST and other >= 2 * (edits + 1) else None


def _whole_segments(edits: int, together: int, longer: int) -> list[tuple[tuple[int, int], ...]]:
    """All (segment, letters that it is moved by) of ``together`` segments, one of which holds for names of at most ``edits`` edits; ``longer`` is the key's length less the name's."""
    found: list[tuple[tuple[int, int], ...]] = []

    def extend(chosen: tuple, segment: int, moved: int, before: int) -> None:
        if len(chosen) == together:
            found.extend([chosen] if abs(longer - moved) <= edits - before else [])
            return
        for k in range(segment, edits + len(chosen) + 1):
            step = k - len(chosen) - before  # the edits since the last
            for to in range(moved - step, moved + step + 1, 2):
                extend((*chosen, (k, to)), k + 1, to, before + step)

    extend((), 0, 0, 0)
    return found


def _segment_places(lengths: dict[int, int], surprise: dict[int, list[float]], counts: dict[int, int], cutoff: float) -> tuple[list[tuple], list[tuple]]:
    """Rows (letters, id of the segments, starts and lengths) for keys and for names.

    ``lengths`` and ``counts`` have the number of keys and names of a length, ``surprise`` the bits of each letter of names.
    """
    ids: dict[tuple, int] = {}
    ours, theirs = set(), set()
    pad = lambda places: sum((*places, *[(1, 0)] * (TOGETHER - len(places))), ())
    for (n, n_keys), (other, n_names) in ((a, b) for a in lengths.items() for b in counts.items()):
        if (edits := _cut(n, other, cutoff)) is None:
            continue
        run, best = np.cumsum([0.0, *(x + 0.01 for x in surprise[other])]), None
        for together in range(1, TOGETHER + 1):
            cuts = [int(np.abs(run - run[-1] * i / (edits + together)).argmin()) for i in range(edits + together + 1)]
            size = lambda k: cuts[k + 1] - cuts[k]  # noqa: B023, E731
            at = [(tuple(k for k, _ in w), [(cuts[k] + to, size(k)) for k, to in w]) for w in _whole_segments(edits, together, n - other)]
            fits = lambda p: p[0][0] >= 0 and sum(p[-1]) <= n and all(sum(a) <= b[0] for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
            at = [(w, p) for w, p in at if fits(p)]
            met = sum(2.0 ** -sum(run[cuts[k + 1]] - run[cuts[k]] for k in w) for w, _ in at)
            sent = n_keys * len(at) + n_names * math.comb(edits + together, together)
            cost = SENT * sent + n_keys * n_names * met
            if best is None or cost < best[0]:
                best = cost, together, cuts, at
        _, together, cuts, at = best
        number = lambda w: ids.setdefault((other, edits, w), len(ids))  # noqa: B023, E731
        ours |= {(n, number(w), *pad([(a + 1, size) for a, size in p])) for w, p in at}
        theirs |= {(other, number(w), *pad([(cuts[k] + 1, cuts[k + 1] - cuts[k]) for k in w])) for w in combinations(range(edits + together), together)}
    return sorted(ours), sorted(theirs)


def _met_by_segments(mine: DataFrame, theirs: DataFrame, ours_at: list[tuple], theirs_at: list[tuple], cutoff: float) -> DataFrame:
    """key, name: what shares segments, and is near enough by edits; with repeats."""
    columns = ["n", "id", *(f"{c}{i}" for i in range(TOGETHER) for c in ("a", "b"))]

    def signed(names: DataFrame, places: list[tuple], c: str) -> DataFrame:
        plan = names.sparkSession.createDataFrame(pa.table({x: pa.array(v, pa.int32()) for x, v in zip(columns, zip(*places, strict=True), strict=True)}))
        part = [F.substring(F.col("name"), F.col(f"a{i}"), F.col(f"b{i}")) for i in range(TOGETHER)]
        rows = names.select("name", F.length("name").alias("n")).join(F.broadcast(plan), "n")  # a few rows for each pair of lengths
        return rows.select(F.xxhash64("id", *part).alias("_sign"), F.col("name").alias(c))

    met = signed(mine, ours_at, "key").join(signed(theirs, theirs_at, "name"), "_sign")
    total = F.length("key") + F.length("name")
    edits = (total - 2 * F.ceil(total * cutoff / 2 - 1e-9)).cast("int")
    return met.withColumn("_edits", edits).where(F.expr("levenshtein(key, name, _edits)") >= 0).select("key", "name")


def fuzzy_candidates(keys: DataFrame, key: str, names: DataFrame, name: str, cutoff: float = CUTOFF) -> DataFrame:
    """key, name: distinct pairs, among them all whose ratio reaches ``cutoff``.

    Pairs agree in segments and are few edits apart, or agree in a run of letters, in lengths that can reach the ratio, and in enough letters.
    NULLs and empty names meet nothing.  Lengths, and the surprise of letters by length and place, pass the driver.
    """
    plain = lambda df, c: df.select(F.col(c).cast("string").alias("name")).where("name <> ''")
    mine, theirs = plain(keys, key), plain(names, name)
    lengths = {r.n: r.rows for r in mine.groupBy(F.length("name").alias("n")).agg(F.count("*").alias("rows")).collect()}
    span = lambda n: range(math.ceil(n * cutoff / (2 - cutoff) - 1e-9), math.floor(n * (2 - cutoff) / cutoff + 1e-9) + 1)
    cut = sorted({other for n in lengths for other in span(n) if _cut(n, other, cutoff) is not None})
    letters = F.when(F.length("name").isin(cut), _letters(F.col("name"))).otherwise(F.array(F.lit("")))
    seen = theirs.select(F.length("name").alias("n"), F.posexplode(letters).alias("at", "letter")).groupBy("n", "at", "letter").agg(F.count("*").alias("often"))
    bits = 2 * F.log2(F.sum("often")) - F.log2(F.sum(F.col("often").cast("double") * F.col("often")))
    rows = seen.groupBy("n", "at").agg(F.sum("often").alias("rows"), bits.alias("bits")).orderBy("n", "at").collect()
    counts, surprise = {r.n: r.rows for r in rows}, {}
    for r in rows:
        surprise.setdefault(r.n, []).append(r.bits)
    mine, theirs, found = mine.distinct(), theirs.distinct(), []
    ours_at, theirs_at = _segment_places(lengths, {n: surprise[n] for n in cut if n in surprise}, counts, cutoff)
    if ours_at:
        found.append(_met_by_segments(mine, theirs, ours_at, theirs_at, cutoff))
    apart = [(n, other) for n in lengths for other in counts if _edits(n, other, cutoff) is not None and _cut(n, other, cutoff) is None]
    if apart or not found:
        has = lambda df, at: df.where(F.length("name").isin(sorted({p[at] for p in apart})))
        found.append(_met_by_runs(has(mine, 0), has(theirs, 1), cutoff))
    return (found[0].unionByName(found[1]) if len(found) > 1 else found[0]).distinct()


def _met_by_runs(keys: DataFrame, names: DataFrame, cutoff: float) -> DataFrame:
    """key, name: what shares a run of letters, and is near enough by lengths and letters; with repeats."""
    qs = range(LONGEST, 0, -1)

    def lettered(df: DataFrame) -> DataFrame:
        rows = df.withColumn("_l", _letters(F.col("name")))
        return rows.select("name", "_l", F.size("_l").alias("n"), _runs(F.col("_l"), 1).alias("letters"))

    theirs = lettered(names).select("name", "n", "letters", F.explode(F.concat(*[_runs(F.col("_l"), q) for q in qs])).alias("token"))
    often = theirs.groupBy("token").agg(F.count("*").alias("often"))
    mine = lettered(keys).select("name", "n", "letters", "_l", *[_shared(F.col("n"), q, cutoff).alias(f"_s{q}") for q in qs])
    ways = F.filter(F.array(*[F.struct(F.lit(q).alias("q"), F.col(f"_s{q}").alias("shared"), _runs(F.col("_l"), q).alias("runs")) for q in qs]), lambda w: w["shared"] >= 1)
    mine = mine.select("name", "n", "letters", F.explode(ways).alias("_w")).select("name", "n", "letters", "_w.q", (F.size("_w.runs") - F.col("_w.shared") + 1).alias("_taken"), F.explode("_w.runs").alias("token"))
    mine = mine.join(often, "token", "left").withColumn("often", F.coalesce("often", F.lit(0)))
    mine = mine.withColumn("_at", F.row_number().over(Window.partitionBy("name", "q").orderBy("often", "token"))).where("_at <= _taken")
    mine = mine.withColumn("_met", F.sum("often").over(Window.partitionBy("name", "q")))
    mine = mine.withColumn("_best", F.min(F.struct("_met", "q")).over(Window.partitionBy("name"))).where("q = _best.q AND often > 0")
    # lengths in bands as wide as the longest step: a partner is in the same band or beside it
    step = (2 - cutoff) / cutoff
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(step))) if step > 1 else F.col("n")
    left = mine.select("token", F.explode(F.array(band - 1, band, band + 1)).alias("_band"), F.col("name").alias("key"), F.col("n").alias("_n"), F.col("letters").alias("_letters"))
    met = left.join(theirs.withColumn("_band", band), ["token", "_band"])
    total = F.col("n") + F.col("_n")
    met = met.where(F.least("n", "_n") * 2 >= total * cutoff - 1e-9).where(F.size(F.array_intersect("letters", "_letters")) * 2 >= total * cutoff - 1e-9)
    return met.select("key", "name")


def fuzzy_match(keys: DataFrame, key: str, names: DataFrame, name: str, cutoff: float = CUTOFF) -> DataFrame:
    """key, match: the nearest name of each distinct key, NULL without; see ``closest``.  Dictionaries of any size."""
    own = keys.select(F.col(key).cast("string").alias("_k")).where(F.col("_k").isNotNull()).distinct()
    pairs = fuzzy_candidates(keys, key, names, name, cutoff).withColumn("r", ratio("name", "key")).where(F.col("r") >= cutoff)
    near = pairs.withColumn("_at", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("r"), F.desc("name")))).where(F.col("_at") <= NEAR)
    words = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(c, r"(?U)\s+"), lambda w: w.isin(sorted(DIRECTIONS)))))
    best = near.where(words(F.col("name")) == words(F.col("key"))).groupBy("key").agg(F.min_by("name", "_at").alias("match"))
    return own.join(best, own["_k"] == best["key"], "left").select(F.col("_k").alias(key), "match")


def guarded(query: Column, label: Column, house_number: Column, place: float = 0.55, address: float = 0.35) -> Column:
    """Whether a label is near enough to a query; addresses are trusted sooner."""
    return ratio(query, label) >= F.when(house_number, address).otherwise(place)


def covered_pairs(labels: DataFrame, label_id: str, label: str, queries: DataFrame, query_id: str, query: str) -> DataFrame:
    """label_id, query_id, n_words, n_hits of every pair for which ``label_covers`` holds.

    Both ids are keys.  Hits are counted where a label is read, before anything is sent.  A query
    without identifying words (n_words = 0) is covered by every label that is not empty.
    """
    words = queries.select(query_id, P.distinct_tokens(query).alias("_words")).where(F.col("_words").isNotNull())
    total, blank = words.agg(F.coalesce(F.sum(F.size("_words")), F.lit(0)), F.count_if(F.size("_words") == 0)).first()
    wanted = words.select(query_id, F.size("_words").cast("long").alias("n_words"), F.explode("_words").alias("_word"))
    own = labels.select(label_id, F.explode(F.array_distinct(F.split(name_key(label), " "))).alias("_word"))
    met = own.join(F.broadcast(wanted) if total <= SHIPPED else wanted, "_word")
    found = met.groupBy(label_id, query_id, "n_words").agg(F.count("*").alias("n_hits")).where("n_hits * 2 >= n_words")
    if not blank:
        return found
    none = words.where(F.size("_words") == 0).select(query_id)
    every = labels.where(F.col(label) != "").select(label_id).crossJoin(F.broadcast(none) if blank <= SHIPPED else none)
    return found.unionByName(every.select(label_id, query_id, F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hits")))
