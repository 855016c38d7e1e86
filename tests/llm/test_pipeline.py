import importlib.util

import corpus_pipeline
from citysense.llm.secret_scan import find_secrets

from .cases import SCHEMA, clashing, frame, random_texts, write_tables
from .test_decontaminate import brute as benchmark_hits
from .test_line_quality import brute as base_counts
from .test_packing import check, library  # noqa: F401
from .test_simhash import brute_components, brute_fingerprint, near_texts

ITEMS = ["w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11", "nothing like this stands in any of the documents at all"]


def texts():
    prose = "A plain line of words that stands by itself and is read by nobody at all, number {}."
    secret = f"{prose.format('x1')}\ntoken = \"ffc3105535f423f352535e4ac53b5fefe076ac6d\" is here."
    leak = f"{prose.format('x2')}\nAnd then W1 w2, w3 w4 w5 w6 w7 w8 w9 w10."
    return [*near_texts(), *[prose.format(f"n{i} v{i * 7} u{i * 11}") for i in range(30)], secret, leak, prose.format("q") + "\nHome | About | Help | Login",
            "", None, "short", *random_texts(10)]


def test_stages_equal_brute_force(spark, tmp_path, library):  # noqa: F811
    every = texts()
    sf_dir = write_tables(spark, tmp_path, every, ITEMS)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        rows = out.collect()
        seen[name] = {r.doc_id: getattr(r, "text", None) for r in rows}
        if name != "packing":
            assert out.columns == docs.columns and len(rows) == len(seen[name])
            docs = spark.createDataFrame(rows, SCHEMA)
    names = [n for n, _ in corpus_pipeline.STAGES]
    clean = seen[names[0]]
    assert set(clean) <= {i for i, t in enumerate(every) if not base_counts(t)["base_failed"]}
    assert all(clean[i] == every[i] for i in range(len(near_texts()) + 30) if i in clean) and len(clean) > 100

    ids = sorted(clean)
    comps = brute_components([brute_fingerprint(clean[i]) for i in ids])
    assert set(seen[names[1]]) == {ids[c] for c in comps}
    items = list(enumerate(ITEMS))
    assert set(seen[names[2]]) == {i for i, t in seen[names[1]].items() if not benchmark_hits(t, items)[1]}
    assert len(seen[names[2]]) < len(seen[names[1]]) < len(clean)
    last = seen[names[3]]
    assert set(last) == set(seen[names[2]])
    assert all(t == seen[names[2]][i] or find_secrets(seen[names[2]][i]) for i, t in last.items())
    assert sum("[REDACTED]" in t for t in last.values()) == 1 and not any(find_secrets(t) for t in last.values())

    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == set(last)
    order = {i: k for k, i in enumerate(sorted(last))}
    renamed = [type(r)(**{**r.asDict(), "doc_id": order[r.doc_id]}) for r in rows]
    check(renamed, [last[i] for i in sorted(last)], library)


def test_stages_on_odd_tables(spark, tmp_path):
    sf_dir = write_tables(spark, tmp_path, ["a"], ITEMS)
    for df in (clashing(frame(spark, [])), clashing(frame(spark, [None, "", "x"])).selectExpr(
            "cast(null as long) doc_id", "text", "cast(null as string) lang", "source", "cast(null as long) n_chars", "id", "key", "`row`", "part")):
        docs = df
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            out.count()
            if name != "packing":
                assert out.columns == docs.columns


def test_entry_adds_the_queries():
    import __spark_entry__ as entry
    names = set(entry.queries())
    assert {f"op{n}_" for n in range(1, 14)} == {f"{x.split('_')[0]}_" for x in names if x.startswith("op")}
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert set(entry.oracle_sql()) <= names
    assert importlib.util.find_spec("corpus_pipeline") is not None
