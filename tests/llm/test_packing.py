import random
import zlib

import numpy as np
import pytest

from citysense.llm.packing import OpenWindows, pack
from citysense.llm.queries import QUERIES
from citysense.llm.tokens import TokenizerFiles, encoder

from .cases import BLANKS, ODD, clashing, frame, library_ids, random_texts, write_tables


@pytest.fixture(scope="module")
def library():
    return library_ids()


def check(rows, texts, library, size=2048):
    ids = {i: [*library(t), 1] for i, t in enumerate(texts)}
    pieces, sequences = {}, {}
    for r in rows:
        assert 0 < r.length <= size and r.doc_tokens == len(ids[r.doc_id])
        own = np.array(ids[r.doc_id][r.start:r.start + r.length], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(own.tobytes())
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for i, own in ids.items():
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at
            at += length
        assert at == len(own)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return sequences


def test_ids_equal_the_library(library):
    encode = encoder(TokenizerFiles())
    for text in [t for t in ODD if t] + BLANKS + random_texts(20):
        assert encode.ids(text).tolist() == library(text), repr(text)[:60]
    assert encode.ids("").tolist() == []


def test_query(spark, tmp_path, library):
    texts = ODD + BLANKS[:-1] + random_texts(80, words=300) + ["long text of words " * 3000]
    rows = QUERIES["op5_window_packing"](spark, write_tables(spark, tmp_path, texts)).collect()
    sequences = check(rows, texts, library)
    total = sum(n for s in sequences.values() for _, n in s)
    assert len(sequences) <= total / 2048 + 2


def test_merging_over_many_partitions(spark, library):
    texts = random_texts(150, words=40)
    df = clashing(frame(spark, texts)).repartition(23)
    rows = pack(df, size=256, open_windows=3, merge_parts=2).collect()
    sequences = check(rows, texts, library, 256)
    assert 256 * len(sequences) < 1.25 * sum(n for s in sequences.values() for _, n in s)
    assert pack(df.where("false")).count() == 0


def test_nulls_and_repeats(spark):
    df = spark.createDataFrame([(None, None), (None, "a"), (3, "a"), (3, "a")], "doc_id long, text string")
    rows = pack(df).collect()
    assert sorted((r.doc_id or 0, r.length) for r in rows) == [(0, 1), (0, 2), (3, 2), (3, 2)]
    assert len({r.sequence_id for r in rows}) == 1


def test_open_windows_are_best_fit_and_bounded():
    rng, state, fills, open_ = random.Random(4), OpenWindows(100, 4), {}, set()
    for _ in range(500):
        n = rng.randrange(1, 100)
        fits = [w for w in open_ if fills[w] + n <= 100]
        window, offset = state.place(n)
        assert offset == fills.get(window, 0)
        if fits:
            assert fills[window] == max(fills[w] for w in fits)
        else:
            assert offset == 0
            if len(open_) == 4:
                open_.remove(max(open_, key=lambda w: (fills[w], w)))
        fills[window] = offset + n
        open_ = (open_ | {window}) - ({window} if fills[window] == 100 else set())
        assert len(open_) <= 4 and {w for _, w in state.open} == open_
