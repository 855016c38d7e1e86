from pyspark.sql import functions as F
import zlib

import pytest

from citysense.llm.queries import QUERIES
from citysense.llm.shards import byte_shards

from .cases import ODD, clashing, frame, random_texts, write_tables


def check(rows, texts, shards):
    sizes = sorted(len((t or "").encode()) + 8 for t in texts)
    assert sorted(r["size"] for r in rows) == sizes
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    total, most = sum(sizes), max(sizes)
    for s in range(shards):
        own = by.get(s, [])
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r["size"] for r in own) - total / shards) <= most + 1
    assert set(by) <= set(range(shards))


def test_query(spark, tmp_path):
    texts = ODD + random_texts(300) + ["copy of one text"] * 400
    rows = QUERIES["op7_byte_shards"](spark, write_tables(spark, tmp_path, texts)).collect()
    check(rows, texts, 24)
    for r in rows:
        text = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 8, zlib.crc32(text), "bytes", None)


def test_shards_are_contiguous_and_copies_adjacent(spark):
    texts = [f"text {i % 7}" for i in range(200)]
    rows = sorted(byte_shards(frame(spark, texts), 5, partitions=6).collect(), key=lambda r: r.prefix)
    assert [r.shard for r in rows] == sorted(r.shard for r in rows)
    assert [r.prefix for r in rows] == [sum(x["size"] for x in rows[:i]) for i in range(len(rows))]
    crcs = [r.text_crc32 for r in rows]
    assert sum(a != b for a, b in zip(crcs, crcs[1:])) == 6


def test_edges(spark):
    df = frame(spark, ["a", "a", None])
    assert byte_shards(df.where("false"), 3).count() == 0
    rows = byte_shards(clashing(df.unionByName(df).selectExpr("if(doc_id = 0, null, doc_id) doc_id", "text")), 3).collect()
    check(rows, ["a", "a", None] * 2, 3)
    assert sum(r.doc_id is None for r in rows) == 2
    assert sorted(r.slot for r in byte_shards(df, 1).collect()) == [0, 1, 2]
    with pytest.raises(ValueError):
        byte_shards(df, 0)


def test_equal_rows_are_split_over_partitions(spark):
    """A third of the rows are one row with a null id: range partitions stay balanced, and slots gapless."""
    df = spark.range(6000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"),
                                  F.when(F.col("id") % 3 > 0, F.col("id").cast("string")).otherwise("the same").alias("text"))
    seen = []
    from citysense.llm import shards

    def spy(frame, real=shards.materialize):
        out = real(frame)
        if "part" in out.columns:
            seen.append([r.n for r in out.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()])
        return out

    try:
        shards.materialize, real = spy, shards.materialize
        placed = byte_shards(df, 5, partitions=8).collect()
    finally:
        shards.materialize = real
    assert max(seen[0]) <= 2 * 6000 / 8 and len(placed) == 6000
    for s in range(5):
        own = sorted(r.slot for r in placed if r.shard == s)
        assert own == list(range(len(own)))
