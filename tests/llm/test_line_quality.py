import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from citysense.llm.line_quality import BOILERPLATE, clean_documents, line_quality
from citysense.llm.queries import QUERIES
from citysense.llm.textbytes import BLANK_WORDS, slices

from .cases import ODD, clashing, frame, random_texts, write_tables

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    hit = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    lines = text.split("\n")
    dup = sum(1 for i, x in enumerate(lines) if WORD.search(x) and x in lines[:i])
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": len(re.findall("[#*$%&|<>]", text)),
           "n_dup_lines": dup, "n_repeat_words": len(hit)}
    return out | {"base_failed": len(words) < 10 or 100 * len(hit) > 20 * len(words)}


def test_base_counts_equal_brute_force(spark, tmp_path):
    texts = ODD + random_texts(60) + ["a b c d e A b c d e x", "a b c d e a b c d e x"]
    got = {r.doc_id: r.asDict() for r in QUERIES["op3_line_quality"](spark, write_tables(spark, tmp_path, texts)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = brute(t)
        assert {k: got[i][k] for k in want} == want, repr(t)[:80]
        assert not (got[i]["kept"] and got[i]["base_failed"])


def test_line_rules(spark):
    prose = "Is and retitioning ouen the of, nterti thorreou ndernt for the day.\n" \
            "A second line of plain words follows it here, and ends well."
    noise = "in%%% the&&& of### on*** it$$$ to%%% was&&& be***"
    shout = "THIS!! IS!! VERY!! LOUD!! INDEED!! SO!!"
    menu = "Home | About | Contact | Login | Help"
    licence = "All rights reserved."
    texts = [prose, f"{prose}\n{noise}", f"{prose}\n{menu}\n{licence}\n{shout}\n", "\n".join([noise] * 3 + [menu] * 2), None]
    df = frame(spark, texts)
    kept = {r.doc_id: r for r in clean_documents(df).collect()}
    assert set(kept) == {0, 1, 2}
    assert kept[0].text == prose and kept[0].n_chars == len(prose)
    assert kept[1].text == prose + "\n" and kept[1].n_chars == len(prose) + 1
    assert kept[2].text == prose + "\n"
    counts = df.select("doc_id", line_quality(F.col("text")).alias("q")).select("doc_id", "q.*").orderBy("doc_id").collect()
    assert [(r.n_punctuation_lines, r.n_navigation_lines, r.n_boilerplate_lines) for r in counts[:3]] == [(0, 0, 0), (1, 0, 0), (1, 1, 1)]
    assert counts[3].lost_share == 1.0 and not counts[3].kept


def test_boilerplate_counts_against_the_document(spark):
    prose = "Ten plain words stand in this one line of text."
    page = "\n".join(f"Page {i}: {p}, see the {i}th note." for i, p in enumerate(BOILERPLATE))
    licence = "This work is licensed under the GNU General Public License, version 3."
    ten = "a day of sun is to be had at sea"
    texts = [f"{page}\nok", f"{page}\n{prose}", f"{prose}\n{page[:60]}", f"{licence}\nOf the day.", f"{prose}\n{licence}", f"{ten}\n{licence}\nAll rights reserved by the owners."]
    q = [r.q for r in frame(spark, texts).select("doc_id", line_quality(F.col("text")).alias("q")).orderBy("doc_id").collect()]
    assert [r.base_failed for r in q] == [False] * 6 and [r.lost_share for r in q] == [0.0] * 6
    for r, text in zip(q, texts, strict=True):
        size = lambda t: sum(len(x) for x in t.split("\n"))
        assert r.removed_share == pytest.approx(1 - size(r.cleaned) / size(text))
    assert [r.kept for r in q] == [False, False, True, False, True, False]
    assert {r.doc_id for r in clean_documents(frame(spark, texts)).collect()} == {2, 4}


def test_other_columns_repeats_and_empty_tables(spark):
    texts = ["Ten plain words stand in this one line of text."] * 3
    df = clashing(frame(spark, texts))
    out = clean_documents(df)
    assert out.columns == df.columns and out.count() == 3
    assert [r.quality for r in out.collect()] == ["extra"] * 3
    assert clean_documents(df.where("false")).count() == 0
    assert clean_documents(df.drop("n_chars")).count() == 3


def test_slices_cover_all_rows():
    import pyarrow as pa
    texts = ["ab cd"] * 7 + ["x" * 100] + [None] * 3 + ["e f"]
    array = pa.array(["skipped", *texts]).slice(1)
    for target in (1, 7, 30, 10_000):
        words, at = [], 0
        for first, data, offsets in slices(array, target):
            assert first == at
            at += len(offsets) - 1
            starts, ends, bounds = BLANK_WORDS.find(data, offsets)
            assert np.all(np.diff(bounds) >= 0)
            words += [bytes(data[i:j]).decode() for i, j in zip(starts, ends, strict=True)]
        assert at == len(texts) and words == " ".join(t or "" for t in texts).split()


@pytest.mark.parametrize("size", [5 << 20])
def test_one_very_long_text(spark, size):
    text = "Some words here and there. " * (size // 27)
    r = frame(spark, [text]).select(line_quality(F.col("text")).alias("q")).select("q.*").first()
    assert r.n_words == 5 * (size // 27) and r.base_failed and not r.kept
