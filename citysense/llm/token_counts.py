"""Operator 8: token counts by section, from one encoding of the whole document.

A document is encoded once, as it stands. Each token has a span of characters;
sections (lines, the fields that were joined to the document, or spans that the
caller gives) are intervals of characters. Both lists are sorted, so the join of
tokens to intervals is a pair of binary searches for each section, inside the
worker that has the document. Nothing is shuffled.

A token that crosses a section's boundary is allocated by the rule:

* ``first``: to the section with its first character (the usual);
* ``last``: to the section with its last character;
* ``most``: to the section with most of its characters, the earlier of equals.

A token that holds part of a character only (bytes of a long UTF-8 sequence)
spans that character. With sections that cover the text without overlap, the
counts add up to the document's tokens under each rule. Characters outside all
sections count for none; overlapping sections each count their own.

Defined results: a null text is an empty one, which has one empty line; with
null or empty given sections a document has no rows; a null id is carried
along; repeated rows give repeated results; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .tokens import TokenizerFiles, encoder

RULES = ("first", "last", "most")
_ROWS = 50_000


def token_spans(text: str, encode) -> tuple[np.ndarray, np.ndarray]:
    """First character and end (exclusive) of each token."""
    ends = np.cumsum(encode.widths[encode.ids(text)])
    raw = np.frombuffer(text.encode(), dtype=np.uint8)
    number = np.cumsum((raw & 0xC0) != 0x80) - 1  # of the character that a byte belongs to
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    return (number[starts], number[ends - 1] + 1) if len(ends) else (starts, ends)


def allocate(first: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: str) -> np.ndarray:
    """How many tokens (spans in text order) each section gets by the rule."""
    place = {"first": first, "last": end - 1}.get(rule)
    if place is None:
        place = np.sort(_most(first, end, starts, ends))
    return np.searchsorted(place, ends) - np.searchsorted(place, starts)


def _most(first: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A character of each token in the section that has most of it; only tokens over a boundary need a look."""
    place, edges = first.copy(), np.unique(np.concatenate([starts, ends]))
    for k in np.flatnonzero(np.searchsorted(edges, first, side="right") < np.searchsorted(edges, end - 1, side="right")):
        inner = edges[np.searchsorted(edges, first[k], side="right"):np.searchsorted(edges, end[k])]
        cuts = np.concatenate([[first[k]], inner, [end[k]]])
        inside = [((starts <= a) & (ends > a)).any() for a in cuts[:-1]]
        place[k] = cuts[np.argmax(np.diff(cuts) * inside)]
    return place


def crossings(first: np.ndarray, end: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """How many tokens lie partly in each section: those that overlap it less those within."""
    overlap = np.searchsorted(first, ends) - np.searchsorted(end, starts, side="right")
    within = np.searchsorted(end, ends, side="right") - np.searchsorted(first, starts)
    return np.where(ends > starts, np.maximum(overlap, 0) - np.maximum(within, 0), 0)


def line_spans(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Every line with its line break; together they are the text."""
    breaks = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) == 10) + 1
    return np.concatenate([[0], breaks]), np.concatenate([breaks, [len(text)]])


def joined_fields(fields: Sequence[str], separator: str = "\n") -> tuple[Column, Column]:
    """The text of a document made of several columns, and its sections: one for each, without the
    separators. A null field is empty."""
    values = [F.coalesce(F.col(x).cast("string"), F.lit("")) for x in fields]
    sections, start = [], F.lit(0)
    for value in values:
        end = start + F.length(value)
        sections.append(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end")))
        start = end + len(separator)
    return F.concat_ws(separator, *values), F.array(*sections)


def token_counts(docs: DataFrame, id_col: str = "doc_id", text: str | Column = "text", sections: Column | None = None,
                 rule: str = "first", files: TokenizerFiles = TokenizerFiles()) -> DataFrame:
    """One row for each section of each document: the id, ``section`` (its number, from 0), ``start``
    and ``end`` (characters, end exclusive), ``n_tokens`` (allocated by the rule) and ``n_crossing``
    (tokens that are only partly in it).

    ``sections``: an array of structs (start, end) in text order, or None for the lines.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}, got {rule!r}")
    spans = F.lit(None).cast("array<struct<start:int,end:int>>") if sections is None else sections
    read = docs.select(F.col(id_col).alias("id"), (F.col(text) if isinstance(text, str) else text).alias("text"), spans.alias("sections"))
    id_type, by_line = read.schema["id"].dataType, sections is None
    kind = to_arrow_type(id_type)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(files)
        held: list[tuple] = []

        def table() -> pa.RecordBatch:
            owners, columns = [], [np.concatenate(c) for c in zip(*(x[1:] for x in held), strict=True)]
            for owner, *rest in held:
                owners += [owner] * len(rest[0])
            held.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(owners, kind), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(),) * 3 + (pa.int64(),) * 2, strict=True))],
                names=["id", "section", "start", "end", "n_tokens", "n_crossing"])

        waiting = 0
        for batch in batches:
            for i in range(batch.num_rows):
                text = batch["text"][i].as_py() or ""
                if by_line:
                    starts, ends = line_spans(text)
                else:
                    given = [s for s in batch["sections"][i].as_py() or () if s]
                    starts, ends = (np.array([s[k] for s in given], dtype=np.int64) for k in ("start", "end"))
                first, end = token_spans(text, encode)
                held.append((batch["id"][i], np.arange(len(starts)), starts, ends, allocate(first, end, starts, ends, rule),
                             crossings(first, end, starts, ends)))
                waiting += len(starts)
                if waiting >= _ROWS:
                    yield table()
                    waiting = 0
        if held:
            yield table()

    out = read.mapInArrow(count, f"id {id_type.simpleString()}, section int, start int, end int, n_tokens long, n_crossing long")
    return out.withColumnRenamed("id", id_col)
