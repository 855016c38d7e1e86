import hashlib
import re

import pytest

from citysense.llm.decontaminate import remove_documents, remove_spans, with_hits
from citysense.llm.queries import QUERIES

from .cases import ODD, clashing, frame, random_texts, write_tables

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items):
    own, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            for i in range(len(own) - size + 1):
                if own[i:i + size] == w[k:k + size]:
                    hit.update(range(i, i + size))
                    found.add(str(item))
    return len(own), len(hit), sorted(found)


ITEMS = [
    "one two three four five six seven eight nine ten eleven twelve", "Short Item here!", "", "...", "é x1",
    "a b c d e a b c d e a", "ONE two-three four, five six seven eight nine ten", "THE the a né of x1 to on it is was die",
]


def texts():
    passage = "one two three four five six seven eight nine ten eleven twelve"
    return [*ODD, *random_texts(40), passage, f"before {passage.title()} after", passage.replace("seven", "sevn"),
            "x " * 30 + "One, two; three four five six seven eight\nnine TEN." + " y" * 30, "short item", "a short item here is", "É X1 é x1",
            " ".join(passage.split()[:9]), (passage + " ") * 3]


@pytest.mark.parametrize("benchmark", [ITEMS, []])
def test_query_equals_brute_force(spark, tmp_path, benchmark):
    every = texts()
    rows = {r.doc_id: r for r in QUERIES["op10_decontamination"](spark, write_tables(spark, tmp_path, every, benchmark)).collect()}
    assert len(rows) == len(every)
    for i, t in enumerate(every):
        n, hit, found = brute(t, list(enumerate(benchmark)))
        r = rows[i]
        assert (r.n_words, r.n_hit, r.n_items, r.contaminated) == (n, hit, len(found), hit > 0), repr(t)[:80]
        assert r.items_sha256 == hashlib.sha256(",".join(found).encode()).hexdigest()


@pytest.mark.parametrize("bound", [{"max_windows": 7}, {"max_bytes": 400}])
def test_blocks_give_the_same(spark, bound):
    every = texts()
    docs = clashing(frame(spark, [*every, *every[-6:]]))  # repeated rows, and columns named as the operator's own
    bench = spark.createDataFrame([*enumerate(ITEMS), (90, ITEMS[0]), (91, ITEMS[0])], "item_id long, text string")
    one = with_hits(docs, bench, "h").select("doc_id", "h").orderBy("doc_id").collect()
    many = with_hits(docs, bench, "h", **bound).select("doc_id", "h").orderBy("doc_id").collect()
    assert one == many and any(r.h["items"] for r in one)
    for remove in (remove_spans, remove_documents):
        a, b = (remove(docs, bench, **k).select("doc_id", "text", "n_chars").orderBy("doc_id").collect() for k in ({}, bound))
        assert a == b


def test_blocks_cut_overlapping_and_nested_windows(spark):
    """Windows of different blocks overlap, and what is left after a cut joins to a window of another item."""
    a, b = "a b c d e f g h i j".split(), "k l m n o p q r s t".split()
    bench = spark.createDataFrame([(1, " ".join(a)), (2, " ".join(a[5:] + b[:5])), (3, " ".join(b)), (4, "u v w x y z 1 2 3 4")], "item_id long, text string")
    docs = frame(spark, [" ".join(a + b), "u v w x y " + " ".join(a + b) + " z 1 2 3 4 end", "left alone", None])
    whole = [r.text for r in remove_spans(docs, bench).orderBy("doc_id").collect()]
    for n in (1, 3):
        assert [r.text for r in remove_spans(docs, bench, max_windows=n).orderBy("doc_id").collect()] == whole
    assert [x and x.split() for x in whole] == [[], ["end"], ["left", "alone"], None]


def test_removal(spark):
    every = texts()
    docs, bench = clashing(frame(spark, every)), spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string")
    clean = {i for i, t in enumerate(every) if not brute(t, list(enumerate(ITEMS)))[1]}
    kept = remove_documents(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == clean
    cut = remove_spans(docs, bench)
    assert cut.columns == docs.columns
    rows = cut.collect()
    assert len(rows) == len(every)
    for r in rows:
        assert not brute(r.text, list(enumerate(ITEMS)))[1]
        if r.doc_id in clean:
            assert r.text == every[r.doc_id]
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert remove_documents(docs.where("false"), bench).count() == 0


def test_null_items_and_repeats(spark):
    bench = spark.createDataFrame([(None, "short item"), (None, "short item"), (3, None)], "item_id long, text string")
    r = with_hits(frame(spark, ["a Short Item", "a short item"]), bench, "h").select("h.*").collect()
    assert [x.asDict() for x in r] == [{"n_words": 3, "words": [1, 2], "items": ["null"]}] * 2
