import random
import re

import numpy as np
import pytest
import xxhash

from citysense.llm.components import connected_components
from citysense.llm.queries import QUERIES
from citysense.llm.simhash import (
    block_count,
    drop_near_duplicates,
    fingerprint_bytes,
    fingerprint_links,
    forest,
    gray_rank,
    near_duplicates,
    top_masks,
)

from .cases import ODD, clashing, frame, random_texts, write_tables


def brute_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def brute_components(values, max_bits=4):
    """The least number of a value connected with each value."""
    label = list(range(len(values)))
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= max_bits and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def test_hubs_keep_every_edge(spark):
    """A hub with most of the edges, chains through it, islands, repeats, loops and nulls."""
    rng = random.Random(5)
    edges = [(i, 7) if i % 2 else (7, i) for i in range(3_000)] + [(i, i + 1) for i in range(4_000, 4_060)]
    edges += [(rng.randrange(5_000, 9_000), rng.randrange(5_000, 9_000)) for _ in range(1_500)] + [(4_030, 2_999), (None, 3)]
    edges += edges[:50] + [(9_500, 9_500)]
    found = connected_components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    root: dict[int, int] = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            low, high = sorted((top(a), top(b)))
            root[high] = low
    assert len(found) == len({r.node for r in found})
    assert {r.node: r.root for r in found} == {x: top(x) for x in root if top(x) != x}


def near_texts():
    rng = random.Random(3)
    base = [" ".join(f"w{rng.randrange(400)}" for _ in range(150)) for _ in range(12)]
    out = list(base)
    for t in base:
        for _ in range(6):
            w = t.split()
            for _ in range(rng.randrange(4)):
                w[rng.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return out


def test_query_equals_brute_force(spark, tmp_path):
    texts = ODD + random_texts(30) + near_texts() + ["An exact copy of a text of many words."] * 5
    rows = {r.doc_id: r for r in QUERIES["op9_simhash_near_dedup"](spark, write_tables(spark, tmp_path, texts)).collect()}
    prints = [brute_fingerprint(t) for t in texts]
    assert [rows[i].fingerprint for i in range(len(texts))] == [f"{x:016x}" for x in prints]
    assert [rows[i].component_id for i in range(len(texts))] == brute_components(prints)
    assert len(set(brute_components(prints))) < len(set(prints))


def clustered(n, seed):
    """Random values, with balls of near ones and chains of near ones."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n):
        x = out[rng.randrange(len(out))]
        for _ in range(rng.randrange(1, 6)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return list(dict.fromkeys(out))


@pytest.mark.parametrize(("usual", "largest", "max_bits"), [(256, 8192, 4), (1e-6, 8192, 4), (256, 8, 4), (256, 8192, 0), (256, 16, 2)])
def test_links_equal_brute_force(spark, usual, largest, max_bits):
    values = clustered(250, 7) + [0, 1, (1 << 64) - 1]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "x long")
    roots = {r.node: r.root for r in connected_components(fingerprint_links(df, "x", max_bits, usual, largest)).collect()}
    want = brute_components(values, max_bits)
    got = [roots.get(v, v) for v in signed]
    assert all((got[i] == got[j]) == (want[i] == want[j]) for i in range(len(values)) for j in range(i))


def test_tops_lose_no_pair():
    assert block_count(10, 4) == 5 and block_count(10**8, 4) == 6 and block_count(10**10, 4) == 7
    rng = random.Random(1)
    for blocks in (5, 6, 8):
        masks = top_masks(blocks, 4)
        assert len(masks) == len(set(masks))
        for _ in range(300):
            diff = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(not diff & m for m in masks)


def test_gray_rank_and_forest():
    n = np.arange(1 << 12, dtype=np.uint64)
    assert (gray_rank(n ^ (n >> np.uint64(1))) == n).all()
    values = np.array(clustered(600, 11), dtype=np.uint64)
    values = values[np.argsort(gray_rank(values))]
    labels = forest(values, np.zeros(len(values), dtype=int), 4)
    assert labels.tolist() == brute_components([int(v) for v in values])
    two = forest(np.array([3, 3], dtype=np.uint64), np.array([0, 1]), 4)
    assert two.tolist() == [0, 1]


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(300, 400)] + [(5, 5), (None, 3), (9, 7), (9, 7)]
    edges += [(rng.randrange(1000, 1100), rng.randrange(1000, 1100)) for _ in range(60)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    label = {x: x for e in edges if None not in e for x in e}
    for _ in label:
        for a, b in edges:
            if a is not None:
                label[a] = label[b] = min(label[a], label[b])
    assert {x: got.get(x, x) for x in label} == label
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dropping(spark):
    texts = near_texts() + ["", None, "  "]
    df = frame(spark, texts)
    rows = clashing(df.unionByName(df.where("doc_id < 3")).selectExpr("if(doc_id = 4, null, doc_id) doc_id", "text", "n_chars"))
    comps = brute_components([brute_fingerprint(t) for t in texts])
    out = drop_near_duplicates(rows)
    assert out.columns == rows.columns
    groups = {}
    for i, c in enumerate(comps):
        groups.setdefault(c, []).append(i)
    want = sorted(min((i for i in g if i != 4), default=-1) for g in groups.values())
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in out.collect()) == want
    assert near_duplicates(rows.where("false")).count() == 0 and drop_near_duplicates(rows.where("false")).count() == 0


def test_long_text():
    text = "aB c\tD é " * 300_000
    assert fingerprint_bytes(text.encode()) == fingerprint_bytes(("ab c d é " * 300_000).encode())
