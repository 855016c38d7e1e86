"""Operator 9: near duplicates by SimHash and a Gray-order hierarchical index.

1. A worker turns each text into a 64-bit fingerprint (an Arrow UDF). Equal
   fingerprints are one class; only classes go on, so copies cost nothing more.
2. Fingerprints are dealt to the top nodes of several trees. The 64 bits are cut
   into blocks; a top node fixes some blocks: its mask and its bits. Two
   fingerprints that differ in at most ``max_bits`` bits agree on at least
   ``blocks - max_bits`` whole blocks, so in one tree they share a top node:
   no link is lost, and no other pairs meet.
3. Below a top node the fingerprints are sorted by Gray rank, which puts similar
   ones side by side. Runs of neighbours get a parent that holds the bits which
   all of them share (mask and pattern), runs of parents a grandparent, and so on.
4. Links are found by descending the tree against itself. A pair of nodes adds
   up the differences in the bits that both fix; a pair with more than
   ``max_bits`` of them is dropped with all that hangs below, and so is a pair
   whose members are known to be connected already. Leaves compare all 64 bits.
5. A top node emits a spanning forest, at most one edge for each member, never
   its pairs. The forests are joined by distributed connected components.

The number of blocks follows from the measured number of classes, so that a top
node has few members at any size. A top node that is still large (a dense ball
of near copies) is dealt into salted parts, and each pair of parts is a task of
bounded size; that is exact too. Broadcast: nothing.

Defined results: a null text is an empty one; empty texts have fingerprint 0,
which links like any other; a null id stands in the result and is no
component's least id unless all of them are null; repeated rows each get their
row; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .components import connected_components
from .store import fresh_name, materialize
from .textbytes import slices

SHINGLE_WORDS = 4
MAX_BITS = 4
#: Members that a top node should have on average, and the most that one task takes at once.
USUAL_NODE, LARGEST_NODE = 256, 8192
FAN_OUT = 8
_STEP_PAIRS = 20_000
_BATCH_ROWS = 50_000
_xxh64 = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint_bytes(text: bytes, shingle: int = SHINGLE_WORDS) -> int:
    """Unsigned fingerprint of a UTF-8 text: a bit is 1 if set in over half the shingle hashes."""
    words = text.lower().split()  # of bytes: A-Z only, and only the six ASCII blanks part words
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    n = max(1, len(words) - shingle + 1)
    first, last = (ends - sizes)[:n].tolist(), ends[min(shingle, len(words)) - 1:].tolist()
    ones, step = np.zeros(64, dtype=np.int64), 1 << 18
    for at in range(0, n, step):
        parts = [joined[a:b] for a, b in zip(first[at:at + step], last[at:at + step], strict=True)]
        hashes = np.fromiter(map(_xxh64, parts), np.uint64, len(parts))
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprint(text: Column, shingle: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a (signed) long."""
    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            out = np.zeros(len(texts), dtype=np.uint64)
            for first, data, offsets in slices(texts):
                held = data.tobytes()
                for i in range(len(offsets) - 1):
                    out[first + i] = fingerprint_bytes(held[offsets[i]:offsets[i + 1]], shingle)
            yield pa.array(out.view(np.int64))

    return F.arrow_udf(compute, "long").asNondeterministic()(text)


def top_masks(blocks: int, max_bits: int) -> list[int]:
    """Masks of the trees' top nodes: each choice of ``blocks - max_bits`` of the blocks of bits."""
    cuts = [round(64 * i / blocks) for i in range(blocks + 1)]
    one = [(1 << cuts[i + 1]) - (1 << cuts[i]) for i in range(blocks)]
    return [sum(x) for x in combinations(one, blocks - max_bits)]


def block_count(n: int, max_bits: int, usual: int = USUAL_NODE) -> int:
    """The least number of blocks for which n random fingerprints give top nodes of ``usual`` members."""
    blocks = max_bits + 1
    while blocks < 2 * max_bits and n > usual * 2.0 ** (64 * (blocks - max_bits) / blocks):
        blocks += 1
    return blocks


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of a code word in the reflected Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


class _Tree:
    """Levels of nodes over leaves sorted by (top node, Gray rank); a node's members are neighbours."""

    def __init__(self, leaves: np.ndarray, top: np.ndarray):
        full = np.full(len(leaves), ~np.uint64(0))
        self.mask, self.bits, self.first = [full], [leaves], [np.arange(len(leaves) + 1)]  # of each level
        owner = top
        while True:
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            if len(heads) == len(owner) and len(self.mask) > 1:
                return
            place = np.arange(len(owner)) - np.repeat(heads, np.diff(np.append(heads, len(owner))))
            starts = np.flatnonzero(place % FAN_OUT == 0)
            ones = np.bitwise_and.reduceat(self.bits[-1] & self.mask[-1], starts)
            zeros = np.bitwise_and.reduceat(~self.bits[-1] & self.mask[-1], starts)
            self.mask.append(ones | zeros)
            self.bits.append(ones)
            self.first.append(np.append(starts, len(owner)))
            owner = owner[starts]

    def joined(self, labels: np.ndarray) -> list[np.ndarray]:
        """For each level, the component that all leaves below a node share, or else -1."""
        out = [labels]
        for first in self.first[1:]:
            low = np.minimum.reduceat(out[-1], first[:-1])
            high = np.maximum.reduceat(out[-1], first[:-1])
            out.append(np.where(low == high, low, -1))
        return out


def _expand(first: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All pairs of children of the node pairs, (parent pair, child, child); of a node with itself each pair once."""
    na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
    sizes = na * nb
    pair = np.repeat(np.arange(len(a)), sizes)
    k = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    x, y = first[a][pair] + k // nb[pair], first[b][pair] + k % nb[pair]
    keep = (a[pair] != b[pair]) | (x <= y)
    return pair[keep], x[keep], y[keep]


def _unite(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (least member of a component) after the links a - b."""
    while True:
        x, y = labels[a], labels[b]
        apart = x != y
        if not apart.any():
            return labels
        a, b, low = a[apart], b[apart], np.minimum(x, y)[apart]
        np.minimum.at(labels, x[apart], low)
        np.minimum.at(labels, y[apart], low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def forest(leaves: np.ndarray, top: np.ndarray, max_bits: int) -> np.ndarray:
    """For fingerprints sorted by (top node, Gray rank): the number of the least leaf that is
    connected with each leaf by links of at most ``max_bits`` bits under its top node."""
    tree, labels = _Tree(leaves, top), np.arange(len(leaves))
    level = len(tree.mask) - 1
    roots = np.arange(len(tree.mask[level]))
    none = np.zeros(len(roots), dtype=np.uint64)
    todo = [(level, roots, roots, np.zeros(len(roots), dtype=np.int64), none)]
    shared = tree.joined(labels)
    while todo:
        level, a, b, apart, done = todo.pop()
        if len(a) > _STEP_PAIRS:
            todo.append((level, *(x[_STEP_PAIRS:] for x in (a, b, apart, done))))
            a, b, apart, done = (x[:_STEP_PAIRS] for x in (a, b, apart, done))
        known = shared[level][a]
        open_ = (known < 0) | (known != shared[level][b])
        pair, x, y = _expand(tree.first[level], a[open_], b[open_])
        level -= 1
        common = tree.mask[level][x] & tree.mask[level][y]
        fresh = common & ~done[open_][pair]
        apart = apart[open_][pair] + np.bitwise_count((tree.bits[level][x] ^ tree.bits[level][y]) & fresh)
        near = apart <= max_bits
        if level:
            own = x == y  # neighbours in Gray order last on the stack, so first: they connect most
            for some in (near & ~own, near & own):
                if some.any():
                    todo.append((level, x[some], y[some], apart[some], common[some]))
        elif (links := near & (x != y)).any():
            labels = _unite(labels, x[links], y[links])
            shared = tree.joined(labels)
    return labels


def _forests(max_bits: int):
    """Reads members sorted by top node and Gray rank; emits the edges of a spanning forest of each node."""
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def edges(rows: np.ndarray) -> pa.RecordBatch:
            keys, leaves = rows[:-1], rows[-1].view(np.uint64)
            top = np.cumsum(np.concatenate([[False], (keys[:, 1:] != keys[:, :-1]).any(axis=0)]))
            order = np.lexsort((gray_rank(leaves), top))
            leaves = leaves[order]
            labels = forest(leaves, top, max_bits)
            at = np.flatnonzero(labels != np.arange(len(labels)))
            return pa.RecordBatch.from_arrays([pa.array(leaves[x].view(np.int64)) for x in (at, labels[at])], names=["a", "b"])

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(batch.num_columns)]))
            if sum(x.shape[1] for x in held) < _BATCH_ROWS:
                continue
            rows = np.concatenate(held, axis=1)
            last = np.flatnonzero((rows[:-1, 1:] != rows[:-1, :-1]).any(axis=0))  # before a new top node
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut:
                yield edges(rows[:, :cut])
            held = [rows[:, cut:]]
        if held and sum(x.shape[1] for x in held):
            yield edges(np.concatenate(held, axis=1))

    return find


def fingerprint_links(classes: DataFrame, column: str, max_bits: int = MAX_BITS, usual: int = USUAL_NODE,
                      largest: int = LARGEST_NODE) -> DataFrame:
    """Edges (a, b) that connect just those distinct fingerprints which chains of links connect."""
    masks = top_masks(block_count(classes.count(), max_bits, usual), max_bits)
    x = F.col(column)
    members = classes.select(F.explode(F.array(*[
        F.struct(F.lit(i).alias("tree"), x.bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("node"), x.alias("x"))
        for i, m in enumerate(masks)])).alias("m")).select("m.*")
    node = ["tree", "node"]
    large = materialize(members.groupBy(*node).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > largest)
                        .withColumn("parts", F.ceil(F.col("n") * 2 / largest).cast("int")))
    usual_ones = members.join(large, node, "left_anti").select(*node, F.lit(0).alias("p"), F.lit(0).alias("q"), "x")
    part = F.pmod(F.xxhash64("x"), F.col("parts")).cast("int")
    split = (members.join(large, node).withColumn("part", part)
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
             .select(*node, F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "x"))
    dealt = usual_ones.unionByName(split).repartition(*node, "p", "q").sortWithinPartitions(*node, "p", "q")
    return dealt.mapInArrow(_forests(max_bits), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS, usual: int = USUAL_NODE, largest: int = LARGEST_NODE) -> DataFrame:
    """One row for each document: ``id``, ``text_hash`` (of the whole text), ``fingerprint`` (long),
    ``root`` (a fingerprint that names the component) and ``component`` (its least id)."""
    text = F.col(text_col)
    found = materialize(docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"),
                                    fingerprint(text, shingle).alias("fingerprint")))
    classes = materialize(found.groupBy("fingerprint").agg(F.min("id").alias("least_id")))
    # a node is named so that the least of a component has its least id: its root is the answer, and no component is gathered
    none, kind = F.col("least_id").isNull(), classes.schema["least_id"].dataType
    named = materialize(classes.select("fingerprint", F.struct(none.alias("none"), F.coalesce("least_id", F.lit("0").cast(kind)).alias("id"),
                                                               F.col("fingerprint").alias("x")).alias("name")))
    links = fingerprint_links(classes, "fingerprint", max_bits, usual, largest)
    for end in ("a", "b"):
        links = links.join(named.select(F.col("fingerprint").alias(end), F.col("name").alias(f"{end}_name")), end)
    roots = connected_components(links, "a_name", "b_name")
    root = F.coalesce("root", "name")
    names = named.join(roots, F.col("name") == F.col("node"), "left").select(
        "fingerprint", root["x"].alias("root"), F.when(~root["none"], root["id"]).alias("component"))
    return found.join(names, "fingerprint").select("id", "text_hash", "fingerprint", "root", "component")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **params) -> DataFrame:
    """One document of each component, with all its columns: that of the least id (nulls last), of
    equal ids that of the least text hash, of repeated rows any one."""
    found = near_duplicates(docs, id_col, text_col, **params)
    first = F.min(F.struct(F.col("id").isNull().alias("null_id"), "id", "text_hash")).alias("first")
    chosen = found.groupBy("root").agg(first).select(_known_as(F.col("first.id")).alias("id"), "first.text_hash")
    name, key, row = (fresh_name(x, docs.columns) for x in ("id_name", "text_hash", "row"))
    keyed = docs.withColumns({name: _known_as(F.col(id_col)), key: F.xxhash64(text_col)})
    # the window is dealt by the join's own keys, so the texts are shuffled once
    kept = keyed.join(materialize(chosen.toDF(name, key)), [name, key], "left_semi")
    again = Window.partitionBy(name, key).orderBy(key)
    return kept.withColumn(row, F.row_number().over(again)).where(F.col(row) == 1).select(*docs.columns)


def _known_as(id_: Column) -> Column:
    """The id as a text that is never null."""
    return F.when(id_.isNull(), "").otherwise(F.concat(F.lit("="), id_.cast("string")))


def fingerprint_text(value: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))
