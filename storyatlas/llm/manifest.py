"""A Merkle manifest of a dataset: leaves, roots by partition, one root, and a proof for every row.

A row's leaf is the SHA-256 of its fields.  Leaves of a group, in the order of
their ids, are gathered into blocks of ``FAN ** DEPTH`` at most; inside a block,
expressions over arrays collapse level after level.  The roots of blocks are
leaves of the next round of blocks, until each group has one root; the groups' roots
make a last tree in the same way.

On the way back each block learns the path of its root, a pair of strings for
every level (the digests on the left and on the right), and extends it for each of
its members.  Rows alone are wide; what travels is a digest for each row, and a path for
each block.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .dedup import ascii_lower
from .ranking import ranked
from .scratch import store

FAN = 8
DEPTH = 4
_STEP = "struct<left:string,right:string>"


def digest(content: Column) -> Column:
    return F.sha2(content, 256)


def encoded(value: Column) -> Column:
    """A field as ``-`` for NULL, else the length in UTF-8 bytes, ``:``, and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*fields: Column) -> Column:
    return digest(F.concat(*[encoded(f) for f in fields]))


def _runs(nodes: Column, fan: int) -> Column:
    """The digests in runs of ``fan`` consecutive ones; the last may be shorter."""
    return F.transform(F.sequence(F.lit(0), F.ceil(F.size(nodes) / F.lit(fan)).cast("int") - 1), lambda i: F.slice(nodes, i * fan + 1, fan))


def _collapse(runs: Column, fan: int) -> Column:
    """Each run becomes the digest of its members; in runs again."""
    return _runs(F.transform(runs, lambda run: digest(F.array_join(run, ""))), fan)


def _blocks(rows: DataFrame, fan: int, depth: int) -> DataFrame:
    """``rows`` (g, pos, node, extra) -> g, block, more (whether g has several), extras, nodes: runs of digests for each level, the leaves first."""
    size = fan**depth
    grouped = rows.groupBy("g", F.expr(f"pos DIV {size}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("pos", "node", "extra"))).alias("_members"))
    grouped = store(grouped, "manifest-members")
    several = grouped.groupBy(F.col("g").alias("_g")).agg((F.count("*") > 1).alias("more"))
    leaves = F.col("_members.node")
    # a lone block stops at its root; of several, each goes all the way
    needed = reduce(lambda a, b: a + b, [(F.size("_members") > fan**i).cast("int") for i in range(depth)])
    levels = F.slice(F.sequence(F.lit(1), F.lit(depth)), F.lit(1), F.when(F.col("more"), F.lit(depth)).otherwise(needed))
    nodes = F.aggregate(levels, F.array(_runs(leaves, fan)), lambda acc, _: F.concat(acc, F.array(_collapse(F.element_at(acc, -1), fan))))
    return store(grouped.join(several, F.col("g") == F.col("_g")).select("g", "block", "more", F.col("_members.extra").alias("extras"), nodes.alias("nodes")), "manifest-blocks")


def _forest(rows: DataFrame, fan: int, depth: int) -> tuple[list[DataFrame], DataFrame]:
    """Blocks of every round, and g, root, round: the root of each group and the round that it is made in."""
    rounds, roots = [], None
    while True:
        blocks = _blocks(rows, fan, depth)
        top = blocks.select("g", "block", "more", F.col("nodes")[F.size("nodes") - 1][0][0].alias("node"))
        made = top.where("NOT more").select("g", F.col("node").alias("root"), F.lit(len(rounds)).alias("round"))
        roots = made if roots is None else roots.unionByName(made)
        rounds.append(blocks)
        rows = top.where("more").select("g", F.col("block").alias("pos"), "node", F.lit(None).cast("string").alias("extra"))
        if rows.isEmpty():
            return rounds, store(roots, "manifest-roots")


def _steps(index: Column, nodes: Column, fan: int) -> Column:
    """The siblings of member ``index`` of a block on each level below the block's root."""

    def step(level: Column, i: Column) -> Column:
        width = F.pow(F.lit(float(fan)), i).cast("long")  # members below a node of this level
        at = F.floor(index / width).cast("int")
        run, slot = level[F.floor(at / F.lit(fan)).cast("int")], at % fan
        return F.struct(F.array_join(F.slice(run, F.lit(1), slot), "").alias("left"), F.array_join(F.slice(run, slot + 2, F.lit(fan)), "").alias("right"))

    return F.transform(F.slice(nodes, F.lit(1), F.size(nodes) - 1), step)


def _members(blocks: DataFrame, above: DataFrame, fan: int, depth: int) -> DataFrame:
    """g, pos, path, top, root for each member of ``blocks``, whose own come from ``above`` (g, block, path, top, root)."""
    joined = blocks.join(above.select(F.col("g").alias("_g"), F.col("block").alias("_b"), "path", "top", "root"), (F.col("g") == F.col("_g")) & (F.col("block") == F.col("_b")))
    paths = F.transform("extras", lambda _, i: F.concat(_steps(i, F.col("nodes"), fan), F.col("path")))
    return joined.select("g", "block", "top", "root", F.posexplode_outer(paths).alias("_i", "path")).select("g", (F.col("block") * fan**depth + F.col("_i")).alias("pos"), "path", "top", "root")


def _down(rounds: list[DataFrame], start: DataFrame, fan: int, depth: int) -> DataFrame:
    """The table ``above`` of the first round's blocks.  ``start``: g, round, path, top, root of each group's root."""
    above = None
    for i in reversed(range(len(rounds))):
        own = start.where(F.col("round") == i).select("g", F.lit(0).cast("long").alias("block"), "path", "top", "root")
        above = store(own if above is None else own.unionByName(above), "manifest-above")
        if i:
            above = _members(rounds[i], above, fan, depth).withColumnRenamed("pos", "block").select("g", "block", "path", "top", "root")
    return above


def merkle_manifest(docs: DataFrame, fan: int = FAN, depth: int = DEPTH, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"), text_col: str = "text", tampered: Column | None = None) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified for each row of ``docs``.

    Rows of a group ascend by id (NULL first); rows that repeat an id by leaf, and
    equal rows are interchangeable.  Groups ascend by the bytes of their name, NULL
    first.  ``tampered`` says which rows are held against a text with A-Z in
    lower case; NULL says no.  A row without siblings has the digest of nothing as its
    proof.  NULL and empty fields differ.  Columns that are not named are
    ignored.  An empty table gives an empty result.
    """
    of = {f: F.col(f) for f in fields}
    changed = leaf(*[ascii_lower(c) if f == text_col else c for f, c in of.items()])
    altered = F.when(F.coalesce(tampered, F.lit(False)), changed) if tampered is not None else F.lit(None).cast("string")
    # a key that is never NULL and sorts as the group does
    key = F.when(F.col(group_col).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(group_col).cast("string")))
    rows = docs.select(key.alias("g"), F.col(id_col).alias("_id"), leaf(*of.values()).alias("node"), altered.alias("_alt"))
    rows = ranked(store(rows, "manifest-leaves"), ["g"], ["_id", "node"], "pos").select("g", "pos", "node", F.struct(F.col("_id").alias("id"), F.col("_alt").alias("alt")).alias("extra"))
    rounds, subroots = _forest(rows, fan, depth)
    tops = ranked(subroots, [], ["g"], "pos").select(F.lit("").alias("g"), "pos", F.col("root").alias("node"), F.struct("g", "round").alias("extra"))
    tops = store(tops, "manifest-tops")
    top_rounds, whole = _forest(tops, fan, depth)
    nothing = F.array().cast(f"array<{_STEP}>")
    above = _down(top_rounds, whole.select("g", "round", nothing.alias("path"), F.lit(None).cast("string").alias("top"), "root"), fan, depth)
    of_groups = _members(top_rounds[0], above, fan, depth).select("pos", "path", "root")
    start = tops.join(of_groups, "pos").select(F.col("extra.g").alias("g"), F.col("extra.round").alias("round"), "path", F.col("node").alias("top"), "root")
    above = _down(rounds, store(start, "manifest-groups"), fan, depth)
    blocks = rounds[0].join(above.select(F.col("g").alias("_g"), F.col("block").alias("_b"), "path", "top", "root"), (F.col("g") == F.col("_g")) & (F.col("block") == F.col("_b")))

    def row(extra: Column, i: Column) -> Column:
        return F.struct(extra["id"].alias("doc_id"), F.col("nodes")[0][F.floor(i / F.lit(fan)).cast("int")][i % fan].alias("leaf"), extra["alt"].alias("alt"), F.concat(_steps(i, F.col("nodes"), fan), F.col("path")).alias("path"))

    def held(r: Column) -> Column:
        siblings = F.array_join(F.transform(r["path"], lambda s: F.concat(s["left"], s["right"])), "")
        folded = F.aggregate(r["path"], F.coalesce(r["alt"], r["leaf"]), lambda acc, s: digest(F.concat(s["left"], acc, s["right"])))
        return F.struct(r["doc_id"].alias("doc_id"), r["leaf"].alias("leaf"), digest(siblings).alias("proof_sha256"), folded.alias("folded_root"))

    rows = blocks.select("top", "root", F.inline_outer(F.transform(F.transform("extras", row), held)))
    return rows.select("doc_id", "leaf", F.col("top").alias("subroot"), "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
