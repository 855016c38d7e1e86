import pytest

from citysense.llm.queries import QUERIES
from citysense.llm.token_counts import joined_fields, token_counts, token_spans
from citysense.llm.tokens import TokenizerFiles, encoder

from .cases import BLANKS, ODD, clashing, frame, library_ids, library_tokenizer, random_texts, write_tables


@pytest.fixture(scope="module")
def library():
    return library_ids()


def brute_counts(spans, sections, rule):
    out = [0] * len(sections)
    for a, b in spans:
        if rule == "first":
            hit = [i for i, (x, y) in enumerate(sections) if x <= a < y]
        elif rule == "last":
            hit = [i for i, (x, y) in enumerate(sections) if x <= b - 1 < y]
        else:
            shares = [min(b, y) - max(a, x) for x, y in sections]
            hit = [shares.index(max(shares))] if shares and max(shares) > 0 else []
        for i in hit:
            out[i] += 1
    return out


@pytest.mark.parametrize("rule", ["first", "last", "most"])
def test_token_counts_equal_brute_force(spark, rule, library):
    texts = ODD + BLANKS[:-1] + random_texts(20) + ["one\n\n\ntwo \n \n three\nüñ\U0001f600\n"]
    rows = token_counts(clashing(frame(spark, texts)), rule=rule).collect()
    encode = encoder(TokenizerFiles())
    for i, t in enumerate(texts):
        t = t or ""
        mine = sorted((r.section, r.start, r.end, r.n_tokens, r.n_crossing) for r in rows if r.doc_id == i)
        lines = [(a, b) for _, a, b, _, _ in mine]
        assert "".join(t[a:b] for a, b in lines) == t and [t[a:b] for a, b in lines] == _lines(t)
        spans = list(zip(*(x.tolist() for x in token_spans(t, encode)), strict=True))
        assert [x[3] for x in mine] == brute_counts(spans, lines, rule), repr(t)[:60]
        assert sum(x[3] for x in mine) == len(library(t))
        assert [x[4] for x in mine] == [sum(a < y and b > x and not (x <= a and b <= y) for a, b in spans) for x, y in lines]


def _lines(text):
    parts = text.split("\n")
    return [p + "\n" for p in parts[:-1]] + parts[-1:]


def test_spans_cover_their_tokens():
    encode = encoder(TokenizerFiles())
    for text in ["né ß \U0001f600\U0001f601 x", *random_texts(5)]:
        first, end = token_spans(text, encode)
        got = library_tokenizer().encode(text, add_special_tokens=False)
        assert len(first) == len(got.ids)
        for (a, b), (x, y), token in zip(zip(first, end, strict=True), got.offsets, got.tokens, strict=True):
            if token.isascii():
                assert (a, b) == (x, y)


def test_given_sections_and_fields(spark):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(1, "head", "one two three"), (2, None, "b"), (None, "x", None)], "doc_id long, title string, text string")
    text, sections = joined_fields(["title", "text"])
    rows = {(r.doc_id, r.section): (r.start, r.end, r.n_tokens) for r in token_counts(df, text=text, sections=sections).collect()}
    assert rows[1, 0] == (0, 4, 1) and rows[1, 1] == (5, 18, 3) and rows[2, 0] == (0, 0, 0) and rows[None, 1] == (2, 2, 0)
    none = F.lit(None).cast("array<struct<start:int,end:int>>")
    assert token_counts(df, sections=none).count() == 0 and token_counts(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        token_counts(df, rule="half")


def test_query_of_counts(spark, tmp_path, library):
    texts = random_texts(10)
    rows = QUERIES["op8_token_counts"](spark, write_tables(spark, tmp_path, texts)).collect()
    assert sum(r.n_tokens for r in rows) == sum(len(library(t)) for t in texts)
