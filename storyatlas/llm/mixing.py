"""Mixing sources to target weights by min-cost flow.

Documents may belong to several sources.  They are aggregated by membership
pattern, so the flow network has a node per pattern, not per document: supply
goes from a pattern (its tokens once at no cost, again at rising cost) to the
quotas of its sources.  The flow says how many tokens of each pattern each
source takes; documents are then selected in seeded order within a pattern.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import sized_broadcast, small_table, store

#: Word characters of the size: all but white space of ASCII.
WORDS = r"[^\\x20\\x09-\\x0D]+"


def word_count(text_col: str) -> Column:
    return F.coalesce(F.expr(f"regexp_count({text_col}, '{WORDS}')"), F.lit(0)).cast("long")


def capped_targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Share ``total`` by weight; none above ``most`` times its size, the excess reshared."""
    target = [0.0] * len(sizes)
    free = {i for i, w in enumerate(weights) if w > 0}
    left = float(total)
    while free:
        weight = sum(weights[i] for i in free)
        over = {i for i in free if left * weights[i] / weight > most * sizes[i]}
        if not over:
            for i in free:
                target[i] = left * weights[i] / weight
            break
        for i in over:
            target[i] = float(most * sizes[i])
            left -= target[i]
        free -= over
    return target


def min_cost_flow(supply: list[int], members: list[list[int]], quota: list[int], copies: int) -> list[list[int]]:
    """Tokens that each source takes of each pattern: flow[pattern][source].

    Successive shortest paths with potentials.  The c-th copy of a pattern's
    tokens costs c (from 0), so no pattern repeats while another that serves the
    same quota has unused tokens.  The network has one node per pattern and per
    source, whatever the number of documents.
    """
    n_p, n_s = len(supply), len(quota)
    first, last = 0, n_p + n_s + 1
    graph: list[list[list]] = [[] for _ in range(last + 1)]  # edges: to, room, cost, place of the reverse

    def edge(a: int, b: int, room: int, cost: int) -> list:
        graph[a].append([b, room, cost, len(graph[b])])
        graph[b].append([a, 0, -cost, len(graph[a]) - 1])
        return graph[a][-1]

    flows: list[list[tuple[int, list, int]]] = []
    for p, tokens in enumerate(supply):
        for c in range(copies):
            edge(first, 1 + p, tokens, c)
        room = tokens * copies
        flows.append([(s, edge(1 + p, 1 + n_p + s, room, 0), room) for s in members[p]])
    for s, tokens in enumerate(quota):
        edge(1 + n_p + s, last, tokens, 0)
    potential = [0] * (last + 1)
    while True:
        dist = [float("inf")] * (last + 1)
        dist[first], via, heap = 0, [None] * (last + 1), [(0, first)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > dist[a]:
                continue
            for e in graph[a]:
                step = d + e[2] + potential[a] - potential[e[0]]
                if e[1] > 0 and step < dist[e[0]]:
                    dist[e[0]], via[e[0]] = step, (a, e)
                    heapq.heappush(heap, (step, e[0]))
        if via[last] is None:
            break
        potential = [p + d if d < float("inf") else p for p, d in zip(potential, dist, strict=True)]
        push, b = float("inf"), last
        while b != first:
            a, e = via[b]
            push, b = min(push, e[1]), a
        b = last
        while b != first:
            a, e = via[b]
            e[1] -= push
            graph[b][e[3]][1] += push
            b = a
    out = [[0] * n_s for _ in range(n_p)]
    for p, edges in enumerate(flows):
        for s, e, room in edges:
            out[p][s] = room - e[1]
    return out


#: Whether seeded order reaches a row, and how often it is taken in all.
_UPTO = "_h < _below OR coalesce(struct(_h, doc_id, _tie) <= _last, false)"
_COPIES = f"_copies + CASE WHEN _below IS NULL THEN 0 WHEN {_UPTO} OR struct(_h, doc_id, _tie) <=> _also THEN 1 ELSE 0 END"


def _cut(cells: DataFrame, by: str) -> DataFrame:
    """_pattern, _at, _left: the cell in which the sum of sizes passes ``_rest``, and what is left for it."""
    run = Window.partitionBy("_pattern").orderBy(by)
    sums = cells.groupBy("_pattern", "_rest", by).agg(F.sum("size").alias("_sum")).withColumn("_upto", F.sum("_sum").over(run))
    hit = sums.where("_upto > _rest").groupBy("_pattern").agg(F.min(F.struct(by, (F.col("_rest") - F.col("_upto") + F.col("_sum")).alias("_left"))).alias("_x"))
    return hit.select("_pattern", F.col(f"_x.{by}").alias("_at"), F.col("_x._left").alias("_left"))


def _cutoffs(rows: DataFrame) -> DataFrame:
    """_pattern, _below, _last, _also: seeded order up to there holds at most ``_rest`` tokens of the pattern.

    ``_also`` is the document behind it whose size comes nearest to what is left, if it helps.

    Found in three steps: by the first 12 bits of the hash, by the next 12, and
    by rank within that one cell.  Only sums per cell cross the network, so a
    pattern of any size needs no single task.
    """
    rows = rows.withColumns({"_c1": F.shiftright("_h", 51), "_c2": F.shiftright("_h", 39).bitwiseAND(F.lit(4095))})
    first = store(_cut(rows, "_c1"), "cut").withColumnRenamed("_at", "_at1")  # a row per pattern, as all below
    inside = rows.drop("_rest").join(F.broadcast(first.withColumnRenamed("_left", "_rest")), "_pattern").where("_c1 = _at1")
    second = store(_cut(inside, "_c2"), "cut").withColumnRenamed("_at", "_at2")
    cell = inside.drop("_rest").join(F.broadcast(second.withColumnRenamed("_left", "_rest")), "_pattern").where("_c2 = _at2")
    upto = F.sum("size").over(Window.partitionBy("_pattern").orderBy("_h", "doc_id", "_tie"))
    last = cell.withColumn("_upto", upto).where("_upto <= _rest").groupBy("_pattern").agg(F.max(F.struct("_h", "doc_id", "_tie")).alias("_last"), F.max("_upto").alias("_took"))
    below = F.shiftleft("_at1", 51) + F.shiftleft("_at2", 39)
    ends = first.join(second.withColumnRenamed("_left", "_rest2"), "_pattern").select("_pattern", below.alias("_below"), "_rest2").join(last, "_pattern", "left")
    ends = store(ends.select("_pattern", "_below", "_last", (F.col("_rest2") - F.coalesce("_took", F.lit(0))).alias("_open")), "ends")
    behind = rows.drop("_rest").join(F.broadcast(ends), "_pattern").where(f"NOT ({_UPTO})").where("abs(size - _open) < _open")
    also = behind.groupBy("_pattern").agg(F.min(F.struct(F.abs(F.col("size") - F.col("_open")).alias("d"), F.struct("_h", "doc_id", "_tie").alias("k"))).alias("_m"))
    return store(ends.join(also.select("_pattern", F.col("_m.k").alias("_also")), "_pattern", "left").drop("_open"), "cutoffs")


def _seeded(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> dict[str, Column]:
    plural = dict(docs.dtypes)[source_col].startswith("array")
    members = F.array(F.col(source_col).cast("string"))
    if plural:
        members = F.when(F.coalesce(F.size(source_col), F.lit(0)) > 0, F.array_sort(F.array_distinct(F.col(source_col).cast("array<string>")))).otherwise(F.array(F.lit(None).cast("string")))
    return {
        "doc_id": F.col(id_col),
        "size": word_count(text_col),
        "_key": F.to_json(F.struct(members.alias("k")), {"ignoreNullFields": "false"}),
        "_members": members,
        "_tie": F.crc32(F.coalesce(F.col(text_col), F.lit(""))),
        "_h": F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), F.crc32(F.coalesce(F.col(text_col), F.lit("")))), 1),  # the text too, as ids may repeat
    }


def mixing_plan(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """The rows (doc_id, size, _key, _h, _tie) and, for each membership pattern, how they are taken."""
    rows = store(docs.select(*[c.alias(n) for n, c in _seeded(docs, seed, id_col, text_col, source_col).items()]), "mix")
    # one row per pattern: as many as there are combinations of sources, not documents
    found = rows.groupBy("_key", "_members").agg(F.sum("size").alias("n")).collect()
    found.sort(key=lambda r: r["_key"])
    names = sorted({m for r in found for m in r["_members"]}, key=lambda x: (x is None, x or ""))
    place = {m: i for i, m in enumerate(names)}
    own = [0] * len(names)
    for r in found:
        for m in r["_members"]:
            own[place[m]] += r["n"]
    target = capped_targets(own, [float(weights[i % len(weights)]) for i in range(len(names))], share * sum(r["n"] for r in found), most)
    supply = [r["n"] for r in found]
    flow = min_cost_flow(supply, [[place[m] for m in r["_members"]] for r in found], [round(t) for t in target], most)
    plan = []
    for i, (r, n, f) in enumerate(zip(found, supply, flow, strict=True)):
        copies, rest = divmod(sum(f), n) if n else (0, 0)
        members = [place[m] for m in r["_members"]]
        plan.append((r["_key"], i, copies, rest, float(sum(target[m] for m in members)), sum(own[m] for m in members)))
    table = small_table(docs.sparkSession, plan, "_key string, _pattern int, _copies long, _rest long, target double, source_size long")
    cut = _cutoffs(rows.join(sized_broadcast(table, len(plan)), "_key").where("_rest > 0").select("_pattern", "_rest", "size", "_h", "doc_id", "_tie"))
    return rows, table.join(cut, "_pattern", "left")


def mix_sources(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken for each row.

    ``source_col`` may also be an array: a document of several sources serves
    any of their quotas, and ``target`` and ``source_size`` are sums over them.
    Sources in order of code points, NULL last, get ``weights`` in turn; together
    they take ``share`` of all words, each at most ``most`` times its own size.
    ``taken`` counts words with repeats: whole documents, up to ``most`` times.
    A NULL text has size 0.  Rows that repeat an id are rows of their own; equal
    rows are taken alike.  An empty table gives an empty result.
    """
    rows, plan = mixing_plan(docs, weights, share, most, seed, id_col, text_col, source_col)
    plan = store(plan, "plan")
    return rows.join(sized_broadcast(plan, plan.count()), "_key").select("doc_id", "size", "source_size", "target", (F.col("size") * F.expr(_COPIES)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, weights=(5, 2, 1), share: float = 1.5, most: int = 2, seed: int = 29, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs``, whole, each as often as ``mix_sources`` takes it.  Texts are not shuffled."""
    _, plan = mixing_plan(docs, weights, share, most, seed, id_col, text_col, source_col)
    plan = store(plan, "plan")
    own = _seeded(docs, seed, id_col, text_col, source_col)
    facts = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), *[own[c].alias(c) for c in ("_key", "_h", "_tie", "doc_id")])
    copies = facts.join(sized_broadcast(plan, plan.count()), "_key").withColumn("_n", F.expr(_COPIES))
    return copies.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_n").cast("int"))).alias("_i")).select("_row.*")
