"""Operator 10: benchmark decontamination by a broadcast hash set of n-grams.

The windows (10 words) of all benchmark items form a hash set that is broadcast;
training texts are scanned window by window against it, every hit is verified
word by word against the benchmark's own words, and the hit words are reported.
Then the spans, or the documents, can be removed.

Texts pass through the workers once, in place (an Arrow UDF); nothing is
shuffled. The broadcast is bounded in rows and bytes, both counted first. A
benchmark beyond that has its distinct windows dealt into blocks, each counted
to be within the bounds; one block at a time is broadcast. The documents are
then written once with a row number, a block yields (row, hit words, windows)
of the documents with hits only, and item ids are joined to the hits in Spark,
so a window that all items share is one broadcast row. Spans are cut by the
hits of all blocks together, round by round until none is left. The results are
the same as those of one block.

Words are runs of ASCII letters, digits and all characters beyond ASCII; A-Z
count as a-z. An item of fewer words than a window is one window of all its
words; one without words can't occur.

Defined results: null and empty texts have no words and no hits; a null item id
is listed as ``null``; repeated items and documents are handled row by row;
empty tables give no hits or no rows; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .store import fresh_name, materialize
from .textbytes import PLAIN_WORDS, covered, per_document, slices, windows

WINDOW = 10
MAX_WINDOWS, MAX_BYTES = 500_000, 128 << 20
HITS = "struct<n_words:long,words:array<int>,items:array<string>>"
_HITS = pa.struct([("n_words", pa.int64()), ("words", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
NUMBERS = "struct<n_words:long,words:array<int>,items:array<long>>"
_NUMBERS = pa.struct([_HITS[0], _HITS[1], ("items", pa.list_(pa.int64()))])
_WINDOWS = "item string, length int, hash long, words binary"


def _join(data: bytes, starts: np.ndarray, ends: np.ndarray) -> bytes:
    return b" ".join(data[i:j] for i, j in zip(starts, ends, strict=True)).lower()


def benchmark_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text",
                      window: int = WINDOW) -> DataFrame:
    """One row for each item and window: item, its length in words, hash and normalised words."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(batch["text"]):
                starts, ends, bounds = PLAIN_WORDS.find(data, offsets)
                hashes, text = PLAIN_WORDS.hashes(data, starts, ends), data.tobytes()
                rows = []
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
                    length = min(window, b - a)
                    if not length:
                        continue
                    found, at = windows(hashes[a:b], np.array([0, b - a]), int(length))
                    item = batch["item"][first + i].as_py()
                    rows += [(item, int(length), int(h), _join(text, starts[a + k:a + k + length], ends[a + k:a + k + length]))
                             for h, k in zip(found.view(np.int64), at, strict=True)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.int64(), pa.binary()), strict=True)],
                        names=["item", "length", "hash", "words"])

    item = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return benchmark.select(item.alias("item"), F.col(text_col).alias("text")).mapInArrow(cut, _WINDOWS).distinct()


class _Block:
    """The windows of one block: for each length the sorted hashes, and the marks of each window (its items, or its number)."""

    def __init__(self, marks: dict[bytes, list], lengths: np.ndarray, hashes: np.ndarray):
        self.marks = marks
        self.by_length = {int(k): np.unique(hashes.view(np.uint64)[lengths == k]) for k in np.unique(lengths)}

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[int, tuple[np.ndarray, set]], tuple]:
        """Word counts, numbers of hit words, for documents with hits (word numbers, marks), and the words."""
        starts, ends, bounds = PLAIN_WORDS.find(data, offsets)
        hashes, text, hit, found = PLAIN_WORDS.hashes(data, starts, ends), None, np.zeros(len(starts), dtype=bool), {}
        for length, known in self.by_length.items():
            seen, at = windows(hashes, bounds, length)
            place = np.minimum(np.searchsorted(known, seen), len(known) - 1)
            true = []
            for k in at[known[place] == seen]:
                text = data.tobytes() if text is None else text
                marks = self.marks.get(_join(text, starts[k:k + length], ends[k:k + length]))
                if marks:
                    true.append(k)
                    found.setdefault(int(np.searchsorted(bounds, k, side="right")) - 1, set()).update(marks)
            hit |= covered(np.array(true, dtype=np.int64), length, len(starts))
        hits = {i: (np.flatnonzero(hit[bounds[i]:bounds[i + 1]]), marks) for i, marks in found.items()}
        return np.diff(bounds), per_document(hit, bounds), hits, (starts, ends, bounds, hit)


class _Benchmark:
    """The windows of a benchmark, as one broadcast or as the blocks of a larger one."""

    def __init__(self, benchmark: DataFrame, id_col: str, text_col: str, window: int, max_windows: int, max_bytes: int):
        self.spark = benchmark.sparkSession
        self.rows = materialize(benchmark_windows(benchmark, id_col, text_col, window))
        self.one = None
        n, size = self.rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("words") + F.octet_length("item")), F.lit(0))).first()
        if n <= max_windows and size <= max_bytes:
            marks: dict[bytes, list] = {}
            found = self.rows.toArrow()
            for item, words in zip(found["item"].to_pylist(), found["words"].to_pylist(), strict=True):
                marks.setdefault(words, []).append(item)
            self.one = self.spark.sparkContext.broadcast(_Block(marks, found["length"].to_numpy(), found["hash"].to_numpy()))
            return
        self.distinct = materialize(self.rows.groupBy("length", "hash", "words").agg(F.count(F.lit(1)).alias("items"))
                                    .withColumn("window", F.monotonically_increasing_id()))
        self.n_blocks, fits = max(1, -(-max(n * max_bytes, size * max_windows) // (max_windows * max_bytes))), False
        while not fits:  # blocks as counted, not as expected; one window alone may be larger
            own = self.distinct.groupBy(self._block().alias("block")).agg(
                F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("words")).alias("size"))
            fits = own.where((F.col("n") > 1) & ((F.col("n") > max_windows) | (F.col("size") > max_bytes))).isEmpty()
            self.n_blocks += 0 if fits else -(-self.n_blocks // 4)

    def _block(self):
        return F.pmod(F.xxhash64("hash", "length"), F.lit(self.n_blocks))

    def hits(self, texts: DataFrame) -> DataFrame:
        """(row, words, windows) of the rows (row, text) with hits, by each block in turn."""
        parts = []
        for k in range(self.n_blocks):
            found = self.distinct.where(self._block() == k).toArrow()
            if not len(found):
                continue
            marks = {w: [i] for w, i in zip(found["words"].to_pylist(), found["window"].to_pylist(), strict=True)}
            shared = self.spark.sparkContext.broadcast(_Block(marks, found["length"].to_numpy(), found["hash"].to_numpy()))
            parts.append(materialize(texts.select("row", _find(shared, NUMBERS, _NUMBERS)("text").alias("h"))
                                     .where(F.size("h.items") > 0).select("row", "h.words", F.col("h.items").alias("windows"))))
            shared.destroy()
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        return every.groupBy("row").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("words")))).alias("words"),
                                        F.flatten(F.collect_list("windows")).alias("windows"))

    def items(self, hits: DataFrame) -> DataFrame:
        """(row, items) for the rows with hits: the ids are joined to the windows here."""
        hit = hits.select("row", F.explode("windows").alias("window"))
        wanted = hit.select("window").distinct()
        named = (self.distinct.join(wanted, "window").select("window", "length", "hash", "words")
                 .join(self.rows, ["length", "hash", "words"]).select("window", "item"))
        return (hit.join(named, "window").select("row", "item").distinct()
                .groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items")))


def _find(shared, kind: str = HITS, arrow: pa.StructType = _HITS):
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            counts, words, marks = [], [[]] * len(texts), [[]] * len(texts)
            for first, data, offsets in slices(texts):
                n_words, _, hits, _ = shared.value.scan(data, offsets)
                counts.append(n_words)
                for i, (own, named) in hits.items():
                    words[first + i], marks[first + i] = own.tolist(), sorted(named)
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(words, arrow[1].type),
                 pa.array(marks, arrow[2].type)], fields=list(arrow))

    return F.arrow_udf(find, kind).asNondeterministic()


@F.arrow_udf(LongType())
def _word_counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        counts = [np.diff(PLAIN_WORDS.find(data, offsets)[2]) for _, data, offsets in slices(texts)]
        yield pa.array(np.concatenate(counts) if counts else [], pa.int64())


def _numbered(docs: DataFrame, row: str) -> DataFrame:
    return materialize(docs.withColumn(row, F.monotonically_increasing_id()))


def with_hits(docs: DataFrame, benchmark: DataFrame, hits_col: str, text_col: str = "text", item_col: str = "item_id",
              item_text_col: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS,
              max_bytes: int = MAX_BYTES) -> DataFrame:
    """The documents with a struct column: ``n_words``, ``words`` (numbers of the hit words, from 0)
    and ``items`` (ids, as strings, of the items with windows that occur), both sorted."""
    found = _Benchmark(benchmark, item_col, item_text_col, window, max_windows, max_bytes)
    if found.one is not None:
        return docs.withColumn(hits_col, _find(found.one)(F.col(text_col)))
    row = fresh_name("row", [*docs.columns, "words", "windows", "items"])
    numbered = _numbered(docs, row)
    hits = materialize(found.hits(numbered.select(F.col(row).alias("row"), F.col(text_col).alias("text"))))
    words, items = fresh_name("words", numbered.columns), fresh_name("items", numbered.columns)
    named = hits.join(found.items(hits), "row").select(F.col("row").alias(row), F.col("words").alias(words), F.col("items").alias(items))
    struct = F.struct(_word_counts(F.col(text_col)).alias("n_words"), F.coalesce(words, F.array().cast("array<int>")).alias("words"),
                      F.coalesce(items, F.array().cast("array<string>")).alias("items"))
    return numbered.join(named, row, "left").withColumn(hits_col, struct).select(*docs.columns, hits_col)


def _without(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hit: np.ndarray, filler: bytes) -> bytes:
    """The text with each run of hit words replaced by the filler."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    parts, at = [], 0
    for a, b in zip(edge[::2], edge[1::2], strict=True):
        parts.append(data[at:starts[a]].tobytes())
        at = ends[b - 1]
    parts.append(data[at:].tobytes())
    return filler.join(parts)


def _cleaned(shared, filler: bytes):
    """Texts without their hit words, again and again until no window is left."""
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            changed = texts.to_pylist()
            for first, data, offsets in slices(texts):
                for i in shared.value.scan(data, offsets)[2]:
                    own = data[offsets[i]:offsets[i + 1]]
                    while (found := shared.value.scan(own, np.array([0, len(own)])))[1][0]:
                        starts, ends, _, hit = found[3]
                        own = np.frombuffer(_without(own, starts, ends, hit, filler), dtype=np.uint8)
                    changed[first + i] = own.tobytes().decode()
            yield pa.array(changed, pa.string())

    return F.arrow_udf(clean, "string").asNondeterministic()


def _cut_words(filler: bytes):
    """Texts without the words of the given numbers."""
    def cut(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, words in batches:
            out = []
            for text, own in zip(texts.to_pylist(), words.to_pylist(), strict=True):
                data = np.frombuffer(text.encode(), dtype=np.uint8)
                starts, ends, _ = PLAIN_WORDS.find(data, np.array([0, len(data)]))
                hit = np.zeros(len(starts), dtype=bool)
                hit[own] = True
                out.append(_without(data, starts, ends, hit, filler).decode())
            yield pa.array(out, pa.string())

    return F.arrow_udf(cut, "string").asNondeterministic()


def _cut_by_blocks(numbered: DataFrame, found: _Benchmark, filler: bytes) -> DataFrame | None:
    """(row, text) of the rows (row, text) that change: each round cuts the hits of all blocks, until a round finds none."""
    active, latest = numbered, None
    while not (hits := materialize(found.hits(active).select("row", "words"))).isEmpty():
        active = materialize(active.join(hits, "row").select("row", _cut_words(filler)("text", "words").alias("text")))
        latest = active if latest is None else materialize(latest.join(active.select("row"), "row", "left_anti").unionByName(active))
    return latest


def remove_spans(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", chars_col: str | None = "n_chars",
                 item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW,
                 max_windows: int = MAX_WINDOWS, filler: str = "\n", max_bytes: int = MAX_BYTES) -> DataFrame:
    """All documents; runs of hit words are replaced by ``filler``, until no window of the benchmark is left."""
    found = _Benchmark(benchmark, item_col, item_text_col, window, max_windows, max_bytes)
    new = fresh_name("cleaned", docs.columns)
    if found.one is not None:
        changed = docs.withColumn(new, _cleaned(found.one, filler.encode())(F.col(text_col)))
    else:
        row = fresh_name("row", [*docs.columns, new])
        numbered = _numbered(docs, row)
        cut = _cut_by_blocks(numbered.select(F.col(row).alias("row"), F.col(text_col).alias("text")), found, filler.encode())
        changed = (numbered.withColumn(new, F.col(text_col)) if cut is None else
                   numbered.join(cut.select(F.col("row").alias(row), F.col("text").alias(new)), row, "left")
                   .withColumn(new, F.coalesce(new, text_col)))
    columns = {text_col: F.col(new)}
    if chars_col in docs.columns:
        columns[chars_col] = F.when(F.col(new).eqNullSafe(F.col(text_col)), F.col(chars_col)).otherwise(
            F.length(new).cast(docs.schema[chars_col].dataType))
    return changed.withColumns(columns).select(*docs.columns)


def remove_documents(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                     item_text_col: str = "text", window: int = WINDOW, max_windows: int = MAX_WINDOWS,
                     max_bytes: int = MAX_BYTES) -> DataFrame:
    """The documents without a hit word, unchanged."""
    found = _Benchmark(benchmark, item_col, item_text_col, window, max_windows, max_bytes)
    if found.one is not None:
        return docs.where(F.size(_find(found.one)(F.col(text_col))["words"]) == 0).select(*docs.columns)
    row = fresh_name("row", docs.columns)
    numbered = _numbered(docs, row)
    hits = found.hits(numbered.select(F.col(row).alias("row"), F.col(text_col).alias("text"))).select(F.col("row").alias(row))
    return numbered.join(hits, row, "left_anti").select(*docs.columns)
