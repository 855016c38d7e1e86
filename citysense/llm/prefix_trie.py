"""Operator 13: trie of the shared prefixes of conversations.

Every distinct sequence of first turns is a node. A turn is known by a 128-bit
id (MD5 of its role and text with their lengths); texts go no further.

*Segments.* A conversation is cut into segments of ``SEGMENT`` turns, so no
matrix is wider than that and no array longer, however long a conversation is.
A segment's row has the id of the turns before it (a hash chain), and
a conversation always ends with a segment that is not full. Segments are worked
through from the deepest up: what lies below a row is carried to its
conversation's row in the segment above, as sums.

*Shards.* The rows of a segment are range-partitioned by (turns before, turns,
conversation) into shards of a bounded number of rows; copies of one
conversation so spread over as many shards as they need.

*In a shard*, rows become a padded matrix of turn ids, sorted by ``numpy.lexsort``.
Marks of columns that differ from the row above, OR-accumulated along the row,
show where nodes start at each depth; ``reduceat`` over these starts adds up
members, children, leaves and saved bytes of all nodes of a depth at once. A node's
saved bytes are those of its members' turns that do not start a node themselves.

*Boundaries.* A shard also gets the last row of the shard before and the first
row of the next. Nodes that go on there are given out as pieces, and pieces of
one node are added up afterwards; there are at most two for each shard and
depth. Lists of conversations that end in such a node are hashed as a stream of
pieces in the order of the shards, never held whole.

Defined results: null role or text counts as empty; rows without a conversation
id belong to no conversation; turns of equal place are ordered by their ids;
repeated rows are turns of their own; turnless conversations are members of the
root; no conversations give no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.stats import attach
from .ranks import ranked
from .store import materialize

SEGMENT, SHARD_ROWS = 128, 20_000
CHUNK = 2_000
EMPTY = hashlib.sha256(b"").hexdigest()
_ID = 32  # hex digits of an id

_OUT = pa.schema([
    ("kind", pa.string()), ("depth", pa.int64()), ("conv", pa.int64()), ("parent", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
    ("n_leaves", pa.int64()), ("saved", pa.int64()), ("ends", pa.string()), ("key", pa.string()), ("parent_key", pa.string()), ("prefix", pa.string()),
    ("lineage", pa.list_(pa.string())), ("chunk", pa.int64())])
_SCHEMA = ("kind string, depth long, conv long, parent long, n_convs long, n_children long, n_leaves long, saved long, ends string, key string, "
           "parent_key string, prefix string, lineage array<string>, chunk long")


def turns_in_order(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, place, id, bytes, turns): each turn's place in its conversation (null turns first), its id, the
    UTF-8 bytes of its text and the conversation's number of turns."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    known = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"),
        F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("id"), F.octet_length(text).cast("long").alias("bytes"))
    return ranked(known, ["conv"], ["turn", "id"], "place", "turns").select("conv", "place", "id", "bytes", "turns")


def _key(prefix: str, path: str) -> str:
    return hashlib.md5((prefix + path).encode()).hexdigest()


def _common(a: tuple[str, str] | None, b: tuple[str, str] | None) -> int:
    """How many first turns two rows (prefix, path) share; -1 if not even what stands before."""
    if a is None or b is None or a[0] != b[0]:
        return -1
    n = 0
    while n * _ID < min(len(a[1]), len(b[1])) and a[1][n * _ID:(n + 1) * _ID] == b[1][n * _ID:(n + 1) * _ID]:
        n += 1
    return n


class _Shard:
    """Sorted rows of one shard as padded matrices."""

    def __init__(self, rows: pa.Table, before: tuple[str, str] | None, after: tuple[str, str] | None, segment: int):
        prefix, path = rows["prefix"].to_pylist(), rows["path"].to_pylist()
        n, self.segment = len(path), segment
        lens = np.array([len(p) // _ID for p in path], dtype=np.int64)
        ids = np.frombuffer("".join(path).encode(), dtype=f"S{_ID}")
        width = int(lens.max())
        inside = np.arange(width) < lens[:, None]
        turn = np.zeros((n, width), dtype=np.int32)  # ids numbered in their order; 0 pads
        turn[inside] = np.unique(ids, return_inverse=True)[1] + 1 if len(ids) else 0
        size = np.zeros((n, width + 1), dtype=np.int64)
        size[:, 0] = rows["own"].to_numpy()
        size[:, 1:][inside] = rows["sizes"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        size[np.flatnonzero(lens == segment), lens[lens == segment]] = 0  # counted by the next segment
        group = np.unique(np.array(prefix), return_inverse=True)[1]
        conv = rows["conv"].to_numpy()
        order = np.lexsort([conv, *(turn[:, j] for j in reversed(range(width))), group])
        turn, size, group, lens = turn[order], size[order], group[order], lens[order]
        self.n, self.width, self.lens, self.conv = n, width, lens, conv[order]
        self.first, self.last = ((prefix[order[i]], path[order[i]]) for i in (0, -1))
        self.prefix, self.path, self.order = prefix, path, order
        changed = np.ones((n, width + 1), dtype=bool)
        changed[1:, 0] = group[1:] != group[:-1]
        changed[1:, 1:] = turn[1:] != turn[:-1]
        self.starts = np.logical_or.accumulate(changed, axis=1)
        self.exists = np.arange(width + 1) <= lens[:, None]
        self.new = self.starts & self.exists
        self.on_left, self.on_right = _common(before, self.first), _common(self.last, after)
        self.new[0, :self.on_left + 1] = False
        saved = np.where(self.exists & ~self.new, size, 0)
        self.saved = np.cumsum(saved[:, ::-1], axis=1)[:, ::-1] + rows["saved_below"].to_numpy()[order][:, None]
        self.leaves = rows["leaves_below"].to_numpy()[order].copy()
        self.levels = [self._level(d) for d in range(min(width, segment - 1) + 1)]
        for level in self.levels:  # a node without children is a leaf; pieces are judged when they are added up
            self.leaves[level["at"][level["there"] & ~level["piece"] & (level["n_children"] == 0)]] += 1
        for level in self.levels:
            level["n_leaves"] = np.add.reduceat(self.leaves, level["at"])

    def _level(self, d: int) -> dict[str, np.ndarray]:
        at = np.flatnonzero(self.starts[:, d])
        piece = np.zeros(len(at), dtype=bool)
        piece[0] |= d <= self.on_left
        piece[-1] |= d <= self.on_right
        children = self.new[:, d + 1] if d < self.width else np.zeros(self.n, dtype=bool)
        return {"at": at, "there": self.exists[at, d], "piece": piece & self.exists[at, d], "n_convs": np.diff(np.append(at, self.n)),
                "conv": np.minimum.reduceat(self.conv, at), "n_children": np.add.reduceat(children.astype(np.int64), at),
                "saved": np.add.reduceat(self.saved[:, d], at), "n_ends": np.add.reduceat((self.lens == d).astype(np.int64), at)}

    def row(self, i: int) -> tuple[str, str]:
        return self.prefix[self.order[i]], self.path[self.order[i]]

    def key(self, i: int, d: int) -> str:
        prefix, path = self.row(i)
        return _key(prefix, path[:d * _ID])

    def parents(self, at: np.ndarray, d: int) -> tuple[list, list]:
        """For nodes of depth d that start at these rows: the parent's least conversation, or its key if it is a piece."""
        if d == 0:
            return [None] * len(at), [None] * len(at)
        level = self.levels[d - 1]
        above = np.searchsorted(level["at"], at, side="right") - 1
        conv, piece = level["conv"][above].tolist(), level["piece"][above]
        held = {int(p): self.key(int(level["at"][p]), d - 1) for p in np.unique(above[piece])}
        return [None if x else c for c, x in zip(conv, piece, strict=True)], [held.get(int(p)) if x else None for p, x in zip(above, piece, strict=True)]

    def ids(self, i: int, n: int) -> str:
        return ",".join(map(str, self.conv[i:i + n].tolist()))

    def results(self, depth: int, part: int) -> Iterator[pa.RecordBatch]:
        """Nodes, pieces, chunks of lists of ends, links to the next segment, and what is carried to the segment above."""
        for d, level in enumerate(self.levels):
            keep = np.flatnonzero(level["there"])
            at, piece = level["at"][keep], level["piece"][keep]
            parent, parent_key = self.parents(at, d)
            n_ends = level["n_ends"][keep]
            ends = [None if p else hashlib.sha256(self.ids(i, n).encode()).hexdigest() if n else EMPTY for i, n, p in zip(at.tolist(), n_ends.tolist(), piece, strict=True)]
            lineage = [[self.key(i, k) for k in range(d + 1)] if p and self.lens[i] == d else None for i, p in zip(at.tolist(), piece, strict=True)]
            yield _batch({"kind": ["piece" if p else "node" for p in piece], "depth": np.full(len(keep), depth + d), "parent": parent, "parent_key": parent_key,
                          "ends": ends, "key": [self.key(i, d) if p else None for i, p in zip(at.tolist(), piece, strict=True)], "lineage": lineage,
                          "prefix": [self.row(i)[0] if d == 0 else None for i in at.tolist()],
                          **{c: level[c][keep] for c in ("conv", "n_convs", "n_children", "n_leaves", "saved")}})
            for i, n in zip(at[piece].tolist(), n_ends[piece].tolist(), strict=True):
                cuts = list(range(0, n, CHUNK))
                if cuts:
                    yield _batch({"kind": ["chunk"] * len(cuts), "key": [self.key(i, d)] * len(cuts), "ends": [self.ids(i + c, min(CHUNK, n - c)) for c in cuts],
                                  "chunk": [(part << 32) + c for c in cuts]})
        if self.width == self.segment:
            at = np.flatnonzero(self.starts[:, self.segment] & self.exists[:, self.segment])
            parent, parent_key = self.parents(at, self.segment)
            yield _batch({"kind": ["link"] * len(at), "key": [self.key(i, self.segment) for i in at.tolist()], "parent": parent, "parent_key": parent_key})
        if depth:
            yield _batch({"kind": ["carry"] * self.n, "conv": self.conv, "n_leaves": self.leaves, "saved": self.saved[:, 0]})


def _batch(columns: dict) -> pa.RecordBatch:
    n = len(columns["kind"])
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _OUT], schema=_OUT)


def _sharded(rows: DataFrame, depth: int, segment: int, shard_rows: int) -> DataFrame:
    """All results of the shards of one segment."""
    spark = rows.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // shard_rows))
    dealt = materialize(rows.repartitionByRange(n, "prefix", "path", "conv").withColumn("part", F.spark_partition_id()))
    ends = dealt.groupBy("part").agg(F.min(F.struct("prefix", "path")).alias("first"), F.max(F.struct("prefix", "path")).alias("last"))
    in_order = Window.orderBy("part")  # one row for each shard
    edges = ends.select("part", F.lag("last").over(in_order).alias("before"), F.lead("first").over(in_order).alias("after"))

    def worked(part: pa.Table, edge: pa.Table) -> pa.Table:
        before, after = ((e["prefix"], e["path"]) if (e := edge[c][0].as_py()) else None for c in ("before", "after"))
        return pa.Table.from_batches(_Shard(part, before, after, segment).results(depth, part["part"][0].as_py()), _OUT)

    return materialize(dealt.groupBy("part").cogroup(edges.groupBy("part")).applyInArrow(worked, _SCHEMA))


def _streamed_hashes(chunks: DataFrame) -> DataFrame:
    """(key, digest): SHA-256 of each key's chunks, comma-joined in order, read as a stream."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        done: list[tuple[str, str]] = []
        for batch in batches:
            for own, text in zip(batch["key"].to_pylist(), batch["ends"].to_pylist(), strict=True):
                if own == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = own, hashlib.sha256()
                state.update(text.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in zip(*done, strict=True)], names=["key", "digest"])
                done = []
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([state.hexdigest()])], names=["key", "digest"])

    ordered = chunks.select("key", "chunk", "ends").repartition("key").sortWithinPartitions("key", "chunk")
    return ordered.mapInArrow(hashed, "key string, digest string")


def _recombined(found: DataFrame) -> DataFrame:
    """One row for each node that spans shards: its pieces added up."""
    pieces = found.where("kind = 'piece'").groupBy("key", "depth").agg(
        F.min("conv").alias("conv"), F.max("parent_key").alias("parent_key"), F.max("prefix").alias("prefix"), F.max("lineage").alias("lineage"),
        *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")])
    pieces = materialize(pieces.withColumn("leaf", F.col("n_children") == 0))
    more = pieces.where("leaf").select(F.explode("lineage").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("more"))
    digests = _streamed_hashes(found.where("kind = 'chunk'"))
    whole = pieces.join(more, "key", "left").join(digests, "key", "left")
    return materialize(whole.withColumns({"n_leaves": F.col("n_leaves") + F.coalesce("more", F.lit(0)), "ends": F.coalesce("digest", F.lit(EMPTY))})
                       .select("key", "depth", "conv", "parent_key", "prefix", "n_convs", "n_children", "n_leaves", "saved", "ends", "leaf"))


def conversation_trie(turns: DataFrame, members: DataFrame | None = None, segment: int = SEGMENT, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The nodes: ``conv_id`` (least member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.

    ``turns``: conv, place (0 on, gapless), id (32 hex digits), bytes, as from ``turns_in_order``;
    ``members``: conv, all conversations, those without turns too (without it, those in ``turns``).
    """
    turns = materialize(turns.select("conv", "place", "id", "bytes"))
    counts = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))
    if members is not None:
        counts = members.select("conv").distinct().join(counts, "conv", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    own = turns.groupBy("conv", F.floor(F.col("place") / segment).cast("int").alias("seg")).agg(
        F.array_sort(F.collect_list(F.struct("place", "id", "bytes"))).alias("t"))  # at most ``segment`` turns
    full = own.select("conv", "seg", F.array_join(F.transform("t", lambda x: x["id"]), "").alias("path"), F.transform("t", lambda x: x["bytes"]).alias("sizes"))
    last = counts.where(F.col("n") % segment == 0).select("conv", (F.col("n") / segment).cast("int").alias("seg"), F.lit("").alias("path"),
                                                          F.array().cast("array<bigint>").alias("sizes"))
    cut = materialize(full.unionByName(last))
    deepest = cut.agg(F.max("seg")).first()[0]
    rows, before = [], None
    for b in range((deepest if deepest is not None else -1) + 1):
        here = cut.where(F.col("seg") == b).drop("seg")
        here = here.withColumns({"prefix": F.lit(""), "own": F.lit(0).cast("long")}) if before is None else here.join(before, "conv")
        rows.append(materialize(here))
        before = rows[-1].where(F.length("path") == segment * _ID).select(
            "conv", F.md5(F.concat("prefix", "path")).alias("prefix"), F.element_at("sizes", -1).alias("own"))
    nodes, carried = [], None
    links: DataFrame | None = None
    found_by_segment = []
    for b in reversed(range(len(rows))):
        below = rows[b].withColumns({"leaves_below": F.lit(0).cast("long"), "saved_below": F.lit(0).cast("long")}) if carried is None else (
            rows[b].join(carried, "conv", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in ("leaves_below", "saved_below")}))
        found = _sharded(below, b * segment, segment, shard_rows)
        spanning = _recombined(found)
        carry = found.where("kind = 'carry'").select("conv", "n_leaves", "saved").unionByName(
            spanning.where("leaf").select("conv", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved")))
        carried = materialize(carry.groupBy("conv").agg(F.sum("n_leaves").alias("leaves_below"), F.sum("saved").alias("saved_below"))) if b else None
        found_by_segment.append((found, spanning))
    for found, spanning in reversed(found_by_segment):
        columns = ["depth", "conv", "parent_key", "prefix", "n_convs", "n_children", "n_leaves", "saved", "ends"]
        every = found.where("kind = 'node'").select(*columns, "parent").unionByName(spanning.select(*columns, F.lit(None).cast("long").alias("parent")))
        known = spanning.select(F.col("key").alias("of"), F.col("conv").alias("of_conv"))
        every = attach(every, known, F.col("parent_key") == F.col("of"), "left", written=True).withColumn("parent", F.coalesce("parent", "of_conv")).drop("of", "of_conv")
        if links is not None:  # the first nodes of a segment hang on the last ones of the segment above
            every = (every.where("prefix IS NULL").unionByName(every.where("prefix IS NOT NULL").drop("parent").join(links, "prefix", "left")))
        nodes.append(every.select("conv", "depth", "parent", "n_convs", "n_children", "n_leaves", "saved", "ends"))
        named = attach(found.where("kind = 'link'").select("key", "parent", "parent_key"), known, F.col("parent_key") == F.col("of"), "left", written=True)
        links = named.groupBy(F.col("key").alias("prefix")).agg(F.min(F.coalesce("parent", "of_conv")).alias("parent"))
    if not nodes:
        return turns.sparkSession.createDataFrame([], "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string")
    out = nodes[0]
    for more in nodes[1:]:
        out = out.unionByName(more)
    return out.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
                      F.col("saved").alias("saved_tokens"), F.col("ends").alias("ends_sha256"))
