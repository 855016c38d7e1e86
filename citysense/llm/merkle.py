"""Operator 12: Merkle manifest of a dataset by a butterfly exchange.

Each row is a leaf; the leaves of a group (a source), in order of id, make a
tree in which every ``fanout`` consecutive nodes become their hash; the roots
of all groups make a tree of the same kind. Every row gets its inclusion proof.

*Leaves* are hashed in the JVM while the texts are read; only digests and ids
travel on. Places come from ``ranked``, so a hot group is split.

*Blocks.* ``fanout ** levels`` leaves in a row are one block. Its subtree is
aligned with the tree of the whole group, so a task hashes it alone.

*Butterfly.* In round r the blocks below one node of that level are joined by
``fanout`` such sets that become one: each block asks its peer in every other
set (the block with the same place there) for that set's root, and hashes the
parent itself. All blocks below a node so compute it redundantly, and after
log rounds each one holds all its upper siblings and the root: no pass back
down the tree. A round moves one row of one digest for each block and sibling;
a last set that is not full is asked evenly. The roots of the groups are then
exchanged in the same way.

*Proofs.* A block's lower siblings are added to its upper ones where its leaves
lie. A proof is an array of (left, right): the hex digests of the siblings on
either side, joined; empty ones for a run of one. ``folded`` hashes a leaf up
along its proof.

Defined results: null columns are hashed as ``-``; rows with a null group are a
group of their own, which comes first; null ids come first; equal ids are
ordered by leaf, and equal rows are leaves of their own; an empty table gives no
rows; columns that are not named are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.stats import attach
from .ranks import ranked
from .store import materialize

FANOUT, LEVELS = 3, 7
PROOF = "array<struct<left:string,right:string>>"
_PROOF = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def leaf_hash(columns: Sequence[str | Column]) -> Column:
    """Hex SHA-256 of the columns, each as ``-`` if null, else as its UTF-8 length, a colon and its text."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda node, side: F.sha2(F.concat(side["left"], node, side["right"]), 256))


def proof_hash(proof: Column) -> Column:
    """Hex SHA-256 of a proof's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda side: F.concat(side["left"], side["right"])), ""), 256)


def _hash(texts: Sequence[str]) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def subtree(leaves: list[str], fanout: int, levels: int | None) -> list[list[str]]:
    """The nodes of each level, from the leaves up: so many levels, or until one node remains."""
    out = [leaves]
    while len(out) <= levels if levels is not None else len(out[-1]) > 1:
        nodes = out[-1]
        out.append([_hash(nodes[i:i + fanout]) for i in range(0, len(nodes), fanout)])
    return out


def siblings(tree: list[list[str]], place: int, fanout: int) -> list[dict[str, str]]:
    """The proof of the leaf at a place: (left, right) for each level below the top."""
    out = []
    for nodes in tree[:-1]:
        run = place - place % fanout
        out.append({"left": "".join(nodes[run:place]), "right": "".join(nodes[place + 1:run + fanout])})
        place //= fanout
    return out


def butterfly(nodes: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """(tree, node, root, proof) from (tree, node, n, hash): the nodes 0 to n - 1 of each tree, already hashed."""
    state = materialize(nodes.select("tree", "node", "n", "hash", F.array().cast(PROOF).alias("proof")))
    most, reach = state.agg(F.max("n")).first()[0] or 0, 1
    while reach < most:
        width = F.ceil(F.col("n") / F.lit(reach)).cast("long")  # nodes of this level
        own = F.floor(F.col("node") / F.lit(reach)).cast("long")
        run = own - own % fanout
        active = state.where(F.col("n") > reach).select("*", own.alias("own"))
        sets = active.select("tree", "node", "n", "own", F.explode(F.sequence(run, F.least(run + fanout, width) - 1)).alias("set"))
        held = F.least(F.lit(reach).cast("long"), F.col("n") - F.col("set") * reach)  # blocks of the set asked
        asked = sets.where("set <> own").select("tree", "node", "set", (F.col("set") * reach + F.col("node") % held).alias("peer"))
        sent = state.select("tree", F.col("node").alias("peer"), F.col("hash").alias("sent"))
        got = asked.join(sent, ["tree", "peer"]).groupBy("tree", "node").agg(F.array_sort(F.collect_list(F.struct("set", "sent"))).alias("got"))
        joined = active.join(got, ["tree", "node"], "left").withColumn("got", F.coalesce("got", F.array().cast("array<struct<set:bigint,sent:string>>")))
        side = lambda keep: F.array_join(F.transform(F.filter("got", lambda g: keep(g["set"], F.col("own"))), lambda g: g["sent"]), "")
        sides = joined.withColumns({"left": side(lambda a, b: a < b), "right": side(lambda a, b: a > b)})
        moved = sides.select("tree", "node", "n", F.sha2(F.concat("left", "hash", "right"), 256).alias("hash"),
                             F.array_append("proof", F.struct("left", "right")).alias("proof"))
        state = materialize(state.where(F.col("n") <= reach).unionByName(moved))
        reach *= fanout
    return state.select("tree", "node", F.col("hash").alias("root"), "proof")


def merkle_manifest(docs: DataFrame, group_col: str = "source", id_col: str = "doc_id",
                    columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), carry: dict[str, Column] | None = None,
                    fanout: int = FANOUT, levels: int = LEVELS) -> DataFrame:
    """One row for each document: ``id``, ``leaf``, ``subroot`` (of its group), ``root``, ``proof``, and the
    carried columns, which are expressions over the documents. A block has ``fanout ** levels`` leaves."""
    carry = carry or {}
    kept = list(carry)
    if fanout < 2 or levels < 1:
        raise ValueError("fanout must be 2 or more, levels 1 or more")
    measured = docs.select(F.col(group_col).cast("string").alias("group"), F.col(id_col).alias("id"), F.unhex(leaf_hash(columns)).alias("leaf"),
                           *[c.alias(name) for name, c in carry.items()])
    placed = ranked(measured, ["group"], ["id", "leaf"], "place", "leaves")
    groups = ranked(placed.groupBy("group").agg(F.count(F.lit(1)).alias("own")), [], ["group"], "tree", "trees")
    known = groups.select(F.col("group").alias("group_"), "tree", "trees")
    width = fanout ** levels
    rows = attach(placed, known, F.col("group").eqNullSafe(F.col("group_"))).select(
        "tree", "trees", "leaves", F.floor(F.col("place") / width).cast("long").alias("block"), (F.col("place") % width).cast("int").alias("at"),
        "id", "leaf", *kept)
    rows = materialize(rows)

    def in_order(part: pa.Table) -> tuple[pa.Table, list[list[str]]]:
        part = part.sort_by("at")
        whole = part["leaves"][0].as_py() <= width
        return part, subtree([x.hex() for x in part["leaf"].to_pylist()], fanout, None if whole else levels)

    def block_root(part: pa.Table) -> pa.Table:
        part, tree = in_order(part)
        return pa.table({"tree": part["tree"][:1], "trees": part["trees"][:1], "node": part["block"][:1], "leaves": part["leaves"][:1], "hash": [tree[-1][0]]})

    roots = rows.select("tree", "trees", "block", "leaves", "at", "leaf").groupBy("tree", "block").applyInArrow(
        block_root, "tree long, trees long, node long, leaves long, hash string")
    roots = materialize(roots.withColumn("n", F.ceil(F.col("leaves") / width).cast("long")))
    inner = butterfly(roots, fanout)
    tops = materialize(inner.where("node = 0").join(roots.where("node = 0").select("tree", "trees"), "tree")
                       .select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("node"), F.col("trees").alias("n"), F.col("root").alias("hash")))
    outer = butterfly(tops, fanout).select(F.col("node").alias("of"), F.col("root").alias("all_root"), F.col("proof").alias("all_proof"))
    upper = materialize(attach(inner, outer, F.col("tree") == F.col("of")).select(
        "tree", F.col("node").alias("block"), F.col("root").alias("subroot"), F.col("all_root").alias("root"), F.concat("proof", "all_proof").alias("proof")))

    kinds = {f.name: f.dataType for f in rows.schema}
    given = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in ["id", *kept])

    def proofs(part: pa.Table, above: pa.Table) -> pa.Table:
        part, tree = in_order(part)
        own = [siblings(tree, i, fanout) + above["proof"][0].as_py() for i in range(len(part))]
        same = lambda c: pa.array([above[c][0].as_py()] * len(part), pa.string())
        return pa.table({"id": part["id"], **{c: part[c] for c in kept}, "leaf": pa.array(tree[0], pa.string()), "subroot": same("subroot"),
                         "root": same("root"), "proof": pa.array(own, _PROOF)})

    return rows.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(
        proofs, f"{given}, leaf string, subroot string, root string, proof {PROOF}")
