import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from citysense.llm.prefix_trie import conversation_trie, turns_in_order
from citysense.llm.queries import QUERIES

TURNS = "conv_id long, turn long, role string, text string"


def brute(sequences):
    """Nodes of conversations {id: [(role, text), ...]}, as rows of the contract."""
    members = defaultdict(list)
    for c, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)

    def below(node):
        yield node
        for child in children[node]:
            yield from below(child)

    out = []
    for node, convs in members.items():
        under = list(below(node))
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(sequences[c]) == len(node)))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]),
                    sum(not children[x] for x in under), sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in under if x),
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def random_conversations(n, seed, longest=7):
    rng = random.Random(seed)
    out = {}
    for c in range(n):
        size = rng.choice([0, 1, 2, 3, 4, 5, 6, longest])
        out[c * 3 + 2] = [("user" if k % 2 else "é", rng.choice(["a", "bb", "ccc é", ""])) for k in range(size)]
        if out and rng.random() < 0.4:
            out[c * 3 + 1] = list(rng.choice(list(out.values())))
    return out


def laid_out(spark, sequences):
    rows = [(c, i, role, text) for c, turns in sequences.items() for i, (role, text) in enumerate(turns)]
    members = spark.createDataFrame([(c,) for c in sequences], "conv long")
    return turns_in_order(spark.createDataFrame(rows, TURNS)), members


@pytest.mark.parametrize("segment, shard_rows, n", [(128, 20, 30), (4, 8, 25)])
def test_shards_and_segments_give_the_same(spark, segment, shard_rows, n):
    sequences = random_conversations(n, seed=segment)
    got = conversation_trie(*laid_out(spark, sequences), segment=segment, shard_rows=shard_rows).collect()
    assert sorted(map(tuple, got), key=str) == brute(sequences)


def test_copies_over_many_shards(spark):
    """One conversation a hundred times, one that goes on from it, and one that is its start."""
    same = [("user", "x"), ("bot", "yy"), ("user", "zzz")]
    sequences = {i: same for i in range(100)} | {500: same + [("bot", "more")], 501: same[:2], 502: [], 503: [("user", "other")]}
    got = conversation_trie(*laid_out(spark, sequences), segment=2, shard_rows=9).collect()
    assert sorted(map(tuple, got), key=str) == brute(sequences)


def rebuilt(rows):
    turns = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    out = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = turns.get(c - c % 5, [])[:h] + own[h:]
    return out


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(4)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "", None, "é é", "long " * 50]))
            for c in range(60) if c % 7 for t in range(rng.choice([1, 2, 5, 8, 12]))]
    rows += [(None, 0, "user", "no conversation"), (3, None, "user", "null turn first")]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    got = QUERIES["op13_prefix_trie"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == brute(rebuilt(rows))


def test_odd_tables(spark):
    rows = [(1, 0, "user", "x"), (1, 0, "user", "x"), (2, 0, "user", "x"), (None, 1, None, None)]
    df = spark.createDataFrame(rows, TURNS)
    extra = df.withColumns({c: F.lit("extra") for c in ("conv", "place", "id", "bytes", "turns", "row", "part", "position", "size")})
    plain = sorted(map(tuple, conversation_trie(turns_in_order(df)).collect()), key=str)
    assert plain == brute({1: [("user", "x")] * 2, 2: [("user", "x")]})
    assert sorted(map(tuple, conversation_trie(turns_in_order(extra)).collect()), key=str) == plain
    none = conversation_trie(turns_in_order(df.where("false")))
    assert none.count() == 0 and none.columns == conversation_trie(turns_in_order(df)).columns
