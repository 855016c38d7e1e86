import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from citysense.llm.merkle import butterfly, folded, merkle_manifest
from citysense.llm.queries import QUERIES
from citysense.llm.ranks import ranked

from .cases import ODD, SCHEMA, clashing, write_tables


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def entry(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """Root and, for each node, its siblings (left, right) by level; over whole lists."""
    proofs, places, level = [[] for _ in nodes], list(range(len(nodes))), list(nodes)
    while len(level) > 1:
        for own, p in enumerate(places):
            run = p // 3 * 3
            proofs[own].append((level[run:p], level[p + 1:run + 3]))
            places[own] = p // 3
        level = [H(*level[i:i + 3]) for i in range(0, len(level), 3)]
    return level[0], proofs


def brute(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, text, lang, source, n_chars)."""
    leaf = lambda r, text: H(*map(entry, (r[0], r[3], r[2], r[4], text)))
    first = lambda v: (v is not None, v if v is not None else 0)
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    groups = [sorted((r for r in rows if r[3] == s), key=lambda r: (first(r[0]), leaf(r, r[1]))) for s in sources]
    inner = [climb([leaf(r, r[1]) for r in g]) for g in groups]
    root, outer = climb([i[0] for i in inner])
    out = []
    for g, (subroot, proofs), top in zip(groups, inner, outer, strict=True):
        for r, proof in zip(g, proofs, strict=True):
            text = r[1].replace("\n", "") if r[0] is not None and r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1]
            node, whole = leaf(r, text), proof + top
            for left, right in whole:
                node = H(*left, node, *right)
            out.append((r[0], leaf(r, r[1]), subroot, root, H(*[x for a, b in whole for x in a + b]), node, node == root))
    return sorted(out, key=str)


def table_of(sizes, texts=("a\nb", None, "", "plain", "é\n")):
    rows = []
    for s, n in enumerate(sizes):
        source = None if s == 1 else "é" * s + f"s{s}"
        rows += [(1000 * s + i * 7 % 997, texts[i % len(texts)], None if i % 4 == 0 else "en", source, i) for i in range(n)]
    return rows


CASES = [[2], [1], [3, 4], [9, 10, 27, 28], [1, 1, 1, 1, 1], [82, 5, 30, 1]]


@pytest.mark.parametrize("levels, cases", [(1, CASES[3:4]), (2, CASES[1:]), (7, CASES[5:6])])
def test_blocks_equal_whole_lists(spark, levels, cases):
    for sizes in cases:
        rows = table_of(sizes)
        made = merkle_manifest(spark.createDataFrame(rows, SCHEMA), levels=levels)
        got = made.select("id", "leaf", "subroot", "root", F.transform("proof", lambda p: F.concat(p["left"], p["right"])).alias("p"), folded(F.col("leaf"), F.col("proof")).alias("f"))
        want = {(w[0], w[1]): w for w in brute(rows)}
        found = got.collect()
        assert len(found) == len(rows)
        for r in found:
            w = want[r.id, r.leaf]
            assert (r.subroot, r.root, H(*r.p), r.f) == (w[2], w[3], w[4], r.root)


def test_query_equals_brute_force(spark, tmp_path):
    rows = [(i, t, "en", f"s{i % 3}", None) for i, t in enumerate(ODD)] + table_of([5, 3]) + [(None, "x\n", None, None, None), (None, None, None, None, None)]
    folder = write_tables(spark, tmp_path, [])
    spark.createDataFrame(rows + rows[-1:], SCHEMA).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    got = QUERIES["op12_merkle_manifest"](spark, folder)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows + rows[-1:])
    tampered = {r.doc_id for r in got.where("NOT verified").collect()}
    assert tampered == {r[0] for r in rows if r[0] is not None and r[1] and "\n" in r[1] and zlib.crc32(str(r[0]).encode()) % 2 == 0}


def test_odd_tables(spark):
    df = spark.createDataFrame(table_of([4, 2]), SCHEMA)
    plain = sorted(merkle_manifest(df).collect(), key=str)
    assert sorted(merkle_manifest(clashing(df)).collect(), key=str) == plain
    assert merkle_manifest(df.where("false")).count() == 0
    assert [(c, t) for c, t in merkle_manifest(df, carry={"shown": F.col("lang")}).dtypes][:2] == [("id", "bigint"), ("shown", "string")]


def test_butterfly_of_odd_sizes(spark):
    """Trees of 1 to 30 nodes at once, fanouts 2 and 3; every node ends with the same root."""
    for fanout in (2, 3):
        rows = [(t, i, t, H(str(i))) for t in range(1, 31) for i in range(t)]
        got = butterfly(spark.createDataFrame(rows, "tree long, node long, n long, hash string"), fanout).collect()
        assert len(got) == len(rows) and len({(r.tree, r.root) for r in got}) == 30
        for r in got:
            node = H(str(r.node))
            for p in r.proof:
                node = H(p.left, node, p.right)
            assert node == r.root


def test_ranks_split_hot_groups(spark):
    rows = [(None if i % 3 == 0 else i % 7, 1 if i % 3 == 0 else i) for i in range(3000)]
    got = ranked(spark.createDataFrame(rows, "g int, x int"), ["g"], ["x"], partitions=8).collect()
    for g in {r.g for r in got}:
        own = sorted((r.position, r.x) for r in got if r.g == g)
        assert [p for p, _ in own] == list(range(len(own))) and [x for _, x in own] == sorted(x for _, x in own)
        assert {r.size for r in got if r.g == g} == {len(own)}
