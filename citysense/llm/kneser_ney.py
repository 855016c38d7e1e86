"""Operator 2: interpolated modified Kneser-Ney n-gram model, counted in Spark.

*Counting.* Workers turn texts into 64-bit word hashes and count n-grams by a
million tokens at a time. The counts travel as packed arrays, one row for each
shard of the n-gram hash space, so a very frequent n-gram is one entry in each
task's array and no key can overload a task. One grouped step for each order
then merges the arrays of a shard, and from the merged n-grams derives what the
next order and the interpolation need: continuation counts, and for each
context its total and how many of its n-grams were seen once, twice, and three
times or more. It is one Spark job; no counts reach the driver but four counts
of counts for each order, from which the three discounts follow.

*Storage.* Every shard is a file of sorted 64-bit hashes and a file for each
value, in the shared checkpoint folder. Shards are ranges of the hash space.
Files are written under a task's own name and then renamed, so a task that is
run again leaves the same files.

*Scoring.* Workers map the files into memory (those of a store that is not
mounted are read into it). They look up the distinct n-grams of some thousand
documents at once, in sorted order and shard by shard; a shard is opened when a
key falls into it, and the least recently used ones are let go beyond
``MOST_MAPPED`` files or ``MOST_READ`` bytes, so maps and memory stay bounded
however large the model is, and nothing is copied to a worker's disk. A document's score is the sum over its tokens of
log10 p(token | the words before it).

    p(w | c) = (max(a(c w) - D(a(c w)), 0) + (D1 N1(c) + D2 N2(c) + D3 N3+(c)) p(w | c')) / a(c .)

with counts a for the highest order and continuation counts below (raw counts
for n-grams at a text's begin), c' the context without its first word, and the
uniform 1 / (V + 1) at the end, which leaves room for unknown words.

Defined results: null and empty texts are one end token; without training
documents every token has probability 1 / (V + 1) with V = 0; a null id trains;
repeated rows count and are scored each; an empty table gives no rows; other
columns are not read. Two words with one 64-bit hash would be taken for one.
"""

from __future__ import annotations

import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .store import materialize, shared_folder
from .textbytes import BLANK_WORDS, fold, mix, slices

BEGIN, END = mix(np.array([11, 12], dtype=np.uint64))
CHUNK_TOKENS = 1 << 20
SHARD_BYTES = 16 << 20
_ROWS = "kind string, shard int, block binary, numbers array<long>"
_NAMES = ["kind", "shard", "block", "numbers"]


# -- packed arrays ---------------------------------------------------------------------------------

def _pack(words: list[np.ndarray], values: list[np.ndarray]) -> bytes:
    """Columns of hashes by a sorted table of the distinct ones, and columns of counts. The rows are
    sorted, the first column and the table are kept as steps, and bytes of equal weight stand
    together, so that the shuffle's compression finds the zeros."""
    held, place = np.unique(np.concatenate(words), return_inverse=True)
    n = len(words[0])
    place = place.reshape(len(words), n).astype(np.uint32)
    order = np.lexsort(place[::-1])
    place = place[:, order]
    place[0] = np.diff(place[0], prepend=np.uint32(0))
    columns = [np.diff(held, prepend=np.uint64(0)), *place, *(v[order].astype(np.int64) for v in values)]
    head = np.array([len(words), len(values), n, len(held)], dtype=np.int64).tobytes()
    return head + b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in columns)


def _unpack(block: bytes) -> tuple[list[np.ndarray], list[np.ndarray]]:
    n_words, n_values, n, n_held = np.frombuffer(block, dtype=np.int64, count=4)
    at = 32

    def column(kind, size):
        nonlocal at
        width = np.dtype(kind).itemsize
        raw = np.frombuffer(block, dtype=np.uint8, count=size * width, offset=at).reshape(width, size)
        at += size * width
        return np.ascontiguousarray(raw.T).view(kind).reshape(-1)

    held = np.cumsum(column(np.uint64, n_held), dtype=np.uint64)
    place = [column(np.uint32, n) for _ in range(n_words)]
    place[0] = np.cumsum(place[0], dtype=np.uint32)
    return [held[p] for p in place], [column(np.int64, n) for _ in range(n_values)]


def _hash(words: list[np.ndarray]) -> np.ndarray:
    out = words[0]
    for w in words[1:]:
        out = fold(out, w)
    return out


def _summed(words: list[np.ndarray], values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Sorted hashes of the distinct rows, their words and the sums of their values."""
    keys = _hash(words)
    order = np.argsort(keys)
    keys = keys[order]
    heads = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    some = order[heads]
    sums = [np.add.reduceat(v[order], heads) if len(heads) else v[:0] for v in values]
    return keys[heads], [w[some] for w in words], sums


def _blocks(kind: str, keys: np.ndarray, words: list[np.ndarray], values: list[np.ndarray], bits: int) -> list[tuple]:
    """Rows (kind, shard, block, -) of sorted keys."""
    owner = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), dtype=np.int64)
    cuts = np.searchsorted(owner, np.arange((1 << bits) + 1))
    return [(kind, s, _pack([w[a:b] for w in words], [v[a:b] for v in values]), None)
            for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if b > a]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(
        columns, (pa.string(), pa.int32(), pa.binary(), pa.list_(pa.int64())), strict=True)], names=_NAMES)


# -- tokens ----------------------------------------------------------------------------------------

def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of each document and its end, and where each document begins (and the last ends)."""
    starts, ends, bounds = BLANK_WORDS.find(data, offsets)
    n_docs = len(offsets) - 1
    begins = bounds + np.arange(n_docs + 1)
    out = np.full(len(starts) + n_docs, END, dtype=np.uint64)
    word = np.ones(len(out), dtype=bool)
    word[begins[1:] - 1] = False
    out[word] = BLANK_WORDS.hashes(data, starts, ends)
    return out, begins


def _columns(tokens: np.ndarray, begins: np.ndarray, order: int) -> list[np.ndarray]:
    """For each token the words before it (begin marks before a document's first) and itself."""
    place = np.arange(len(tokens)) - np.repeat(begins[:-1], np.diff(begins))
    out = []
    for back in range(order - 1, 0, -1):
        before = np.full(len(tokens), BEGIN, dtype=np.uint64)
        before[back:] = tokens[:-back] if len(tokens) > back else tokens[:0]
        before[place < back] = BEGIN
        out.append(before)
    return [*out, tokens]


def _count(order: int, bits: int, chunk: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        waiting = 0

        def counted() -> pa.RecordBatch:
            words = [np.concatenate(c) for c in zip(*held, strict=True)]
            held.clear()
            return _batch(_blocks(f"gram{order}", *_summed(words, [np.ones(len(words[0]), dtype=np.int64)]), bits))

        for batch in batches:
            for _, data, offsets in slices(batch["text"]):
                tokens, begins = _tokens(data, offsets)
                held.append(_columns(tokens, begins, order))
                waiting += len(tokens)
                if waiting >= chunk:
                    yield counted()
                    waiting = 0
        if held:
            yield counted()

    return count


# -- files -----------------------------------------------------------------------------------------

def _filesystem(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def _write(folder: str, name: str, array: np.ndarray) -> None:
    store, root = _filesystem(folder)
    store.create_dir(root, recursive=True)
    own = f"{root}/{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        out.write(memoryview(np.ascontiguousarray(array)).cast("B") if len(array) else b"")
    store.move(own, f"{root}/{name}")


def _read(folder: str, name: str, kind) -> np.ndarray:
    """A file as an array: mapped where the shared folder is mounted, else read into memory."""
    store, root = _filesystem(folder)
    path = f"{root}/{name}"
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, dtype=kind, mode="r") if os.path.getsize(path) else np.zeros(0, dtype=kind)
    with store.open_input_file(path) as source:
        return np.frombuffer(source.read(), dtype=kind)


#: How many mapped files, and how many bytes of files read, a worker holds open at once.
MOST_MAPPED, MOST_READ = 1_024, 64 << 20


class _Open:
    """The shards in use, least recently used first; a shard is opened when a key falls into it."""

    def __init__(self, most_mapped: int = MOST_MAPPED, most_read: int = MOST_READ):
        self.most_mapped, self.most_read, self.held = most_mapped, most_read, OrderedDict()
        self.mapped = self.read = 0

    def shard(self, folder: str, kind: str, shard: int, wide: tuple[int, ...]) -> list[np.ndarray]:
        key = (folder, kind, shard)
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        at = f"{kind}-{shard:06d}"
        found = [_read(folder, f"{at}.keys", np.uint64),
                 *[_read(folder, f"{at}.{name}", np.uint64 if w else np.uint32) for name, w in zip(_values(kind), wide, strict=True)]]
        self._count(found, 1)
        self.held[key] = found
        while len(self.held) > 1 and (self.mapped > self.most_mapped or self.read > self.most_read):
            self._count(self.held.popitem(last=False)[1], -1)
        return found

    def _count(self, arrays: list[np.ndarray], sign: int) -> None:
        for x in arrays:
            if isinstance(x, np.memmap):
                self.mapped += sign
            else:
                self.read += sign * x.nbytes


_OPEN = _Open()


def _values(kind: str) -> tuple[str, ...]:
    """The value files of a kind: n-grams' adjusted counts (of single words also the raw ones); contexts'
    totals and followers seen once, twice, more."""
    if kind.startswith("context"):
        return "total", "once", "twice", "more"
    return ("count", "raw") if kind == "gram1" else ("count",)


def _merge(folder: str, bits: int):
    """Merges the blocks of one kind and shard, writes its files, and emits blocks for the lower order.

    Below the highest order blocks hold two values: the adjusted count, and how often the words stand at
    the end of an n-gram of the highest order, which for single words is their raw count.
    """
    def merge(group: pa.Table) -> pa.Table:
        kind, shard = group["kind"][0].as_py(), group["shard"][0].as_py()
        if kind.startswith("file"):
            return group
        parts = [_unpack(b.as_py()) for b in group["block"]]
        words = [np.concatenate(c) for c in zip(*(p[0] for p in parts), strict=True)]
        values = [np.concatenate(c) for c in zip(*(p[1] for p in parts), strict=True)]
        del parts
        keys, words, values = _summed(words, values)
        _write(folder, f"{kind}-{shard:06d}.keys", keys)
        kept = [values[0], values[-1]] if kind == "gram1" else values[:1] if kind.startswith("gram") else values
        wide = [int(len(v) > 0 and v.max() >= 1 << 32) for v in kept]
        for name, v, w in zip(_values(kind), kept, wide, strict=True):
            _write(folder, f"{kind}-{shard:06d}.{name}", v.astype(np.uint64 if w else np.uint32))
        rows, numbers = [], [len(keys), int(values[0].sum()), int(values[-1].sum())]
        if kind.startswith("gram"):
            order, counts, raw = len(words), values[0], values[-1]
            numbers += [int((counts == k).sum()) for k in (1, 2, 3, 4)]
            ones = np.ones(len(keys), dtype=np.int64)
            if order > 1:
                # contexts by their hash only: nothing below needs their words
                context = _hash(words[:-1])
                rows += _blocks(f"context{order}", *_summed([context], [counts, ones * (counts == 1), ones * (counts == 2), ones * (counts > 2)]), bits)
                below = np.where(words[1] == BEGIN, counts, ones)
                rows += _blocks(f"gram{order - 1}", *_summed(words[1:], [below, raw]), bits)
        numbers += wide
        rows.append((f"file:{kind}", shard, None, numbers))
        return pa.Table.from_batches([_batch(rows)])

    return merge


# -- the model -------------------------------------------------------------------------------------

def discounts(seen: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many n-grams have count 1, 2, 3, 4; halves where there are too few to tell."""
    n1, n2, n3, n4 = seen
    usual = (0.5, 1.0, 1.5)
    if not n1 or not n2:
        return usual
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else usual[2])
    return tuple(float(d) if 0 < d <= k else usual[k - 1] for k, d in enumerate(raw, 1))


@dataclass(frozen=True)
class KneserNeyModel:
    """What workers need to score: where the files are, and some numbers for each order."""

    folder: str
    order: int
    bits: int
    #: for each kind, which shards there are: (shard, its value files that hold 64-bit numbers)
    files: dict[str, tuple[tuple[int, tuple[int, ...]], ...]]
    discounts: tuple[tuple[float, float, float], ...]
    #: tokens of the training texts, distinct ones, and the sum of the words' continuation counts and their counts of 1, 2 and more
    train_tokens: int
    vocabulary: int
    words: tuple[int, int, int, int]

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """One row for each document: the id, ``n_tokens`` (words and one end), ``n_known`` (tokens seen in
        training), ``base_score`` (add-one unigram model) and ``score``, both log10 probabilities."""
        read = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        id_type = read.schema["id"].dataType
        out = read.mapInArrow(_scoring(self, to_arrow_type(id_type)),
                              f"id {id_type.simpleString()}, n_tokens long, n_known long, base_score double, score double")
        return out.withColumnRenamed("id", id_col)

    def delete(self) -> None:
        """Removes the model's files."""
        store, root = _filesystem(self.folder)
        store.delete_dir(root)


def train(docs: DataFrame, text_col: str = "text", order: int = 2, shard_bytes: int = SHARD_BYTES,
          chunk_tokens: int = CHUNK_TOKENS) -> KneserNeyModel:
    """Counts the texts of ``docs`` and writes the model's files to the shared checkpoint folder."""
    if order < 1:
        raise ValueError(f"order must be 1 or more, got {order}")
    texts = docs.select(F.col(text_col).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text") + 1)).first()[0] or 0
    bits = max(0, int(size) // shard_bytes).bit_length()
    folder = shared_folder(docs.sparkSession, "kneser-ney")
    rows = texts.mapInArrow(_count(order, bits, chunk_tokens), _ROWS)
    for _ in range(order + 1):  # the orders from the highest, then the contexts of the lowest
        rows = rows.groupBy("kind", "shard").applyInArrow(_merge(folder, bits), _ROWS)
    found = materialize(rows.select("kind", "shard", "numbers")).collect()  # a row for each kind and shard

    files: dict[str, list] = {}
    sums: dict[str, np.ndarray] = {}
    for r in sorted(found, key=lambda r: (r.kind, r.shard)):
        kind = r.kind.removeprefix("file:")
        n = 7 if kind.startswith("gram") else 3
        files.setdefault(kind, []).append((r.shard, tuple(r.numbers[n:])))
        sums[kind] = sums.get(kind, np.zeros(n, dtype=np.int64)) + np.array(r.numbers[:n])
    grams = [sums.get(f"gram{k}", np.zeros(7, dtype=np.int64)).tolist() for k in range(1, order + 1)]
    n, total, tokens, once, twice = grams[0][:5]
    return KneserNeyModel(folder, order, bits, {k: tuple(v) for k, v in files.items()}, tuple(discounts(g[3:7]) for g in grams),
                          tokens, n, (total, once, twice, n - once - twice))


class _Files:
    """The shards of one kind, looked up shard by shard."""

    def __init__(self, model: KneserNeyModel, kind: str):
        self.folder, self.kind, self.bits, self.names = model.folder, kind, model.bits, _values(kind)
        self.shards = dict(model.files.get(kind, ()))

    def find(self, keys: np.ndarray) -> list[np.ndarray]:
        """The values of sorted distinct keys; 0 for those that the files don't have."""
        out = [np.zeros(len(keys)) for _ in self.names]
        owner = keys >> np.uint64(64 - self.bits) if self.bits else np.zeros(len(keys), dtype=np.uint64)
        cuts = np.searchsorted(owner, np.arange((1 << self.bits) + 1, dtype=np.uint64))
        for shard in np.flatnonzero(np.diff(cuts)).tolist():
            if shard not in self.shards:
                continue
            a, b = cuts[shard], cuts[shard + 1]
            held, *values = _OPEN.shard(self.folder, self.kind, shard, self.shards[shard])
            if not len(held):
                continue
            place = np.minimum(np.searchsorted(held, keys[a:b]), len(held) - 1)
            same = held[place] == keys[a:b]
            for column, v in zip(out, values, strict=True):
                column[a:b][same] = v[place[same]]
        return out


def _discounted(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return counts - np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


def token_probabilities(model: KneserNeyModel, tokens: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """p(token | before) of each token, and its count in the training texts."""
    grams, contexts = ([_Files(model, f"{name}{k}") for k in range(least, model.order + 1)] for name, least in (("gram", 1), ("context", 2)))
    columns = _columns(tokens, begins, model.order)
    words, place = np.unique(tokens, return_inverse=True)
    adjusted, counts = (v[place] for v in grams[0].find(words))
    total, once, twice, more = model.words
    d = model.discounts[0]
    p = np.full(len(tokens), 1 / (model.vocabulary + 1))
    if total:
        own = _discounted(adjusted, d)
        p = (own + (d[0] * once + d[1] * twice + d[2] * more) * p) / total
    for k in range(2, model.order + 1):
        context = _hash(columns[-k:-1])
        keys, place = np.unique(context, return_inverse=True)
        all_, one, two, three = (v[place] for v in contexts[k - 2].find(keys))
        keys, place = np.unique(fold(context, tokens), return_inverse=True)
        d = model.discounts[k - 1]
        own = _discounted(grams[k - 1].find(keys)[0], d)[place]
        known = all_ > 0
        p[known] = ((own + (d[0] * one + d[1] * two + d[2] * three) * p)[known]) / all_[known]
    return p, counts


def _scoring(model: KneserNeyModel, kind: pa.DataType):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in slices(batch["text"]):
                tokens, begins = _tokens(data, offsets)
                p, counts = token_probabilities(model, tokens, begins)
                n_docs = len(offsets) - 1
                owner = np.repeat(np.arange(n_docs), np.diff(begins))
                base = np.log10((counts + 1) / (model.train_tokens + model.vocabulary + 1))
                total = lambda v: np.bincount(owner, v, minlength=n_docs)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [batch["id"].slice(first, n_docs).cast(kind), pa.array(np.diff(begins), pa.int64()),
                     pa.array(total(counts > 0).astype(np.int64)), pa.array(total(base)), pa.array(total(np.log10(p)))],
                    names=["id", "n_tokens", "n_known", "base_score", "score"])

    return score


def held_out(id_: Column, folds: int = 7, fold_: int = 2) -> Column:
    """Whether crc32 of the id as text falls into the held-out fold; a null id does as no text."""
    return F.pmod(F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == fold_


def score_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = 2) -> DataFrame:
    """Trains on the documents that are not held out, scores all."""
    model = train(docs.where(~held_out(F.col(id_col))), text_col, order)
    return model.score(docs, id_col, text_col).select(
        id_col, held_out(F.col(id_col)).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"),
        "base_score", "score")
