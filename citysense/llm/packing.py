"""Operator 5: bounded-space online packing of tokenised documents into windows.

Each partition streams its documents: a document is encoded once, an end id is
added, and whole windows are cut from its front. What is left goes into the open
window with the least room that still holds it (best fit). Where none holds it,
a new window is opened; if ``open_windows`` are open already, the fullest is
emitted first. So a partition holds ``open_windows`` fill counts, whatever its
size. A full window is emitted at once.

At its end a partition has leftovers, at most ``open_windows``. They are merged
in rounds: the leftovers of ``merge_parts`` partitions at a time are put
together, largest first and best fit, and the ``open_windows`` emptiest stay
open for the next round, until one group is left. A task never gets more than
``merge_parts * open_windows`` (id, fill) rows. Merging moves whole windows, so
no text is read again.

Only pieces (id, position, length, checksum, window) leave the workers, not the
token ids; they are written to the shared checkpoint folder once, and all later
steps read that.

Defined results: null and empty texts are one end id; a null id is carried
along; repeated rows are packed as separate documents; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .store import materialize
from .tokens import TokenizerFiles, encoder

WINDOW, END_ID = 2048, 1
OPEN_WINDOWS, MERGE_PARTS = 64, 64
_ROWS = 20_000


class OpenWindows:
    """The open windows of one partition, sorted by fill."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.open: list[tuple[int, int]] = []  # (fill, window)
        self.next = 0

    def new(self) -> int:
        self.next += 1
        return self.next - 1

    def place(self, length: int) -> tuple[int, int]:
        """(window, offset) for a piece shorter than a window."""
        at = bisect_left(self.open, (self.size - length + 1, -1)) - 1  # the fullest with room
        if at >= 0:
            fill, window = self.open.pop(at)
        else:
            if len(self.open) == self.most:
                self.open.pop()  # emits the fullest
            fill, window = 0, self.new()
        if fill + length < self.size:
            insort(self.open, (fill + length, window))
        return window, fill


def _pieces(kind: pa.DataType, size: int, end_id: int, most: int, files: TokenizerFiles):
    numbers = ["start", "length", "ids_crc32", "doc_tokens", "window", "offset", "left"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, encode, end = TaskContext.get().partitionId(), encoder(files), np.array([end_id], dtype=np.uint32)
        windows, rows, owners = OpenWindows(size, most), [], []
        tag = part << 32

        def table() -> pa.RecordBatch:
            columns = [pa.array(owners, kind), *(pa.array(c, pa.int64()) for c in zip(*rows, strict=True)),
                       pa.array([part] * len(rows), pa.int32())]
            rows.clear(), owners.clear()
            return pa.RecordBatch.from_arrays(columns, names=["id", *numbers, "part"])

        for batch in batches:
            for i in range(batch.num_rows):
                ids = np.concatenate([encode.ids(batch["text"][i].as_py() or ""), end])
                raw, n, at, owner = ids.astype("<u4").tobytes(), len(ids), 0, batch["id"][i]
                while at < n:
                    length = min(size, n - at)
                    window, offset = (windows.new(), 0) if length == size else windows.place(length)
                    rows.append((at, length, zlib.crc32(raw[4 * at:4 * (at + length)]), n, tag | window, offset, None))
                    owners.append(owner)
                    at += length
                if len(rows) >= _ROWS:
                    yield table()
        for fill, window in windows.open:
            rows.append((None, None, None, None, tag | window, None, fill))
            owners.append(None)
        if rows:
            yield table()

    return pack


def _merge(size: int, most: int, last: bool):
    """Leftovers of a group: largest first into the fullest that holds them. Says for each window where it
    went (the window it is in now, its offset there) and which of these are open for another round."""
    def merge(group: pa.Table) -> pa.Table:
        part = group["part"][0].as_py()
        order = sorted(zip(group["fill"].to_pylist(), group["window"].to_pylist(), strict=True), key=lambda x: (-x[0], x[1]))
        bins: list[tuple[int, int]] = []  # (fill, window)
        moved = []
        for fill, window in order:
            at = bisect_left(bins, (size - fill + 1, -1)) - 1
            used, into = bins.pop(at) if at >= 0 else (0, window)
            moved.append((window, into, used))
            insort(bins, (used + fill, into))
        fills = {window: fill for fill, window in bins}
        still = {window for _, window in ([] if last else bins[:most])}
        columns = list(zip(*[(*m, fills[m[1]]) for m in moved], strict=True))
        return pa.table([*(pa.array(c, pa.int64()) for c in columns), pa.array([m[0] == m[1] and m[0] in still for m in moved]),
                         pa.array([part] * len(moved), pa.int32())], names=["window", "into", "shift", "fill", "open", "part"])

    return merge


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WINDOW, end_id: int = END_ID,
         open_windows: int = OPEN_WINDOWS, merge_parts: int = MERGE_PARTS,
         files: TokenizerFiles = TokenizerFiles()) -> DataFrame:
    """One row for each piece: the id, ``start`` and ``length`` (in the document's ids, the end id
    included), ``ids_crc32``, ``doc_tokens``, ``sequence_id`` and ``offset`` (in the sequence)."""
    read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = read.schema["id"].dataType
    cut = _pieces(to_arrow_type(id_type), size, end_id, open_windows, files)
    packed = materialize(read.mapInArrow(
        cut, f"id {id_type.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, "
             "left long, part int"))

    open_, places = packed.where("left IS NOT NULL").select("window", F.col("left").alias("fill"), "part"), None
    parts = (open_.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        last = parts <= merge_parts
        moved = materialize(open_.withColumn("part", F.floor(F.col("part") / merge_parts).cast("int")).groupBy("part").applyInArrow(
            _merge(size, open_windows, last), "window long, into long, shift long, fill long, open boolean, part int"))
        step = moved.select("window", "into", "shift")
        places = step if places is None else (
            places.join(step.toDF("into", "then", "more"), "into", "left")
            .select("window", F.coalesce("then", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift")))
        if last:
            break
        open_ = moved.where("open").select("window", "fill", "part")
        parts = -(-parts // merge_parts)
    return packed.where("left IS NULL").join(places, "window", "left").select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens",
        F.coalesce("into", "window").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
