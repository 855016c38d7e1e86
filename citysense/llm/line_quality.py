"""Operator 3: line-first quality rules.

Every line of a document is judged by itself: a line of noise punctuation, of
navigation or of boilerplate is removed. Then the document is judged by what it
lost: one that loses too large a share of its text to noise and navigation
(boilerplate aside), or to all three rules together, or has too few words left,
is rejected, as is one that fails the base counts (too few words, or too many
words in repeated word windows).

The work is a column function (an Arrow UDF): texts go to the workers once, all
other columns of the row stay where they are, and nothing is shuffled. Words,
lines and windows are found with numpy over a few megabytes of text at a time.

Words are compared as written, case and all.

Defined results: a null or empty text has all counts 0, keeps no text and is
rejected (fewer words than the least); repeated rows get equal answers; an
empty table gives no rows; other columns are untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import fresh_name
from .textbytes import LINES, PLAIN_WORDS, WRITTEN_WORDS, covered, per_document, seen_in_document, slices, windows

#: Phrases of page furniture and licences; a short line that holds one is boilerplate.
BOILERPLATE = (
    "all rights reserved", "accept cookies", "cookie policy", "enable javascript", "javascript is disabled",
    "licensed under", "log in to continue", "privacy policy", "sign up for our newsletter", "skip to content",
    "subscribe to our newsletter", "terms and conditions", "terms of service", "terms of use", "use of cookies",
)
SYMBOLS = b"#*$%&|<>"
BULLETS = b"|>/"


@dataclass(frozen=True)
class Rules:
    """Thresholds. The base ones: ``min_words`` and ``max_repeat_percent`` of words in a
    window of ``window`` words that the text has twice or more."""

    min_words: int = 10
    window: int = 5
    max_repeat_percent: int = 20
    #: punctuation: noise signs (symbols, and ! or ? beyond one a word's end) for each word
    max_noise_per_word: float = 0.6
    #: punctuation: share of the line's signs that are neither letters, digits nor blanks
    max_sign_share: float = 0.4
    #: navigation: bars and arrows for each word, in lines with two or more of them
    max_bullets_per_word: float = 0.3
    #: boilerplate: a line of at most so many words that holds one of BOILERPLATE
    max_boilerplate_words: int = 25
    #: the document: the largest share of its text (UTF-8 bytes of lines, boilerplate aside) that noise and navigation may take
    max_lost_share: float = 0.4
    #: the document: the largest share of all its text that the three rules together may take; one licence line below a short text fits in
    max_removed_share: float = 0.6


DEFAULT_RULES = Rules()
RESULT = ("struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,"
          "kept:boolean,n_lines:long,n_punctuation_lines:long,n_navigation_lines:long,n_boilerplate_lines:long,"
          "lost_share:double,removed_share:double,cleaned:string>")


def _bytes_in(values: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(values)] = True
    return out


_SYMBOL, _BULLET, _SHOUT = _bytes_in(SYMBOLS), _bytes_in(BULLETS), _bytes_in(b"!?")
_SIGN = ~(PLAIN_WORDS.inside | _bytes_in(b" \t\n\x0b\x0c\r"))
#: Bytes that begin a code point.
_LEADING = np.array([b & 0xC0 != 0x80 for b in range(256)])


def _between(flags: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=sums[1:])
    return sums[ends] - sums[starts]


def _judge(data: np.ndarray, offsets: np.ndarray, rules: Rules) -> dict:
    n_docs = len(offsets) - 1
    starts, ends, bounds = WRITTEN_WORDS.find(data, offsets)
    n_words = np.diff(bounds)
    hashes = WRITTEN_WORDS.hashes(data, starts, ends)
    owner = np.repeat(np.arange(n_docs), n_words)

    in_word = WRITTEN_WORDS.inside[data]
    out = {"n_words": n_words,
           "word_chars": per_document(in_word & _LEADING[data], offsets),
           "n_symbols": per_document(_SYMBOL[data], offsets)}

    found, at = windows(hashes, bounds, rules.window)
    twice, _ = seen_in_document(found, owner[at])
    out["n_repeat_words"] = per_document(covered(at[twice], rules.window, len(hashes)), bounds)

    first, last, line_bounds = LINES.find(data, offsets)
    line_words = np.searchsorted(starts, last) - np.searchsorted(starts, first)
    with_word = line_words > 0
    line_owner = np.repeat(np.arange(n_docs), np.diff(line_bounds))
    _, repeated = seen_in_document(LINES.hashes(data, first, last)[with_word], line_owner[with_word])
    out["n_dup_lines"] = np.bincount(line_owner[with_word][repeated], minlength=n_docs)

    least = np.maximum(line_words, 1)
    symbols, bullets = _between(_SYMBOL[data], first, last), _between(_BULLET[data], first, last)
    shouts = np.zeros(len(data), dtype=bool)  # a ! or ? right after another
    shouts[1:] = _SHOUT[data[1:]] & _SHOUT[data[:-1]]
    shouts[offsets[:-1][offsets[:-1] < len(data)]] = False  # nothing stands before a document's first character
    points = _between(_LEADING[data], first, last)
    signs = _between(_SIGN[data], first, last)
    navigation = with_word & (bullets >= 2) & (bullets > rules.max_bullets_per_word * least)
    noise = symbols - np.minimum(symbols, bullets) + _between(shouts, first, last)
    punctuation = with_word & ~navigation & ((noise > rules.max_noise_per_word * least)
                                             | (signs > rules.max_sign_share * np.maximum(points, 1)))
    text = data.tobytes()
    boilerplate = np.zeros(len(first), dtype=bool)
    low = text.lower()
    for phrase in BOILERPLATE:
        place = low.find(phrase.encode())
        while place >= 0:
            line = int(np.searchsorted(first, place, side="right")) - 1
            boilerplate[line] |= place + len(phrase) <= last[line]
            place = low.find(phrase.encode(), place + 1)
    boilerplate &= ~navigation & ~punctuation & (line_words <= rules.max_boilerplate_words)

    removed = navigation | punctuation | boilerplate
    per_doc = lambda flags, weights=None: np.bincount(line_owner[flags], weights, minlength=n_docs)
    size = (last - first).astype(float)
    noise_lines = navigation | punctuation
    everything, lost = per_doc(~boilerplate, size[~boilerplate]), per_doc(noise_lines, size[noise_lines])
    out |= {"n_lines": np.diff(line_bounds), "n_punctuation_lines": per_doc(punctuation),
            "n_navigation_lines": per_doc(navigation), "n_boilerplate_lines": per_doc(boilerplate),
            "lost_share": lost / np.maximum(everything, 1),
            "removed_share": per_doc(removed, size[removed]) / np.maximum(np.bincount(line_owner, size, minlength=n_docs), 1)}
    out["base_failed"] = (n_words < rules.min_words) | (100 * out["n_repeat_words"] > rules.max_repeat_percent * n_words)
    words_left = n_words - per_doc(removed, line_words[removed].astype(float))
    out["kept"] = (~out["base_failed"] & (out["lost_share"] <= rules.max_lost_share)
                   & (out["removed_share"] <= rules.max_removed_share) & (words_left >= max(rules.min_words, 1)))

    cleaned = []
    touched = per_doc(removed) > 0
    for i in range(n_docs):
        if not touched[i]:
            cleaned.append(text[offsets[i]:offsets[i + 1]])
            continue
        parts, at_byte = [], offsets[i]
        for j in range(line_bounds[i], line_bounds[i + 1]):
            if removed[j]:  # with its line break
                parts.append(text[at_byte:first[j]])
                at_byte = min(last[j] + 1, offsets[i + 1])
        parts.append(text[at_byte:offsets[i + 1]])
        cleaned.append(b"".join(parts))
    out["cleaned"] = cleaned
    return out


def line_quality(text: Column, rules: Rules = DEFAULT_RULES) -> Column:
    """A struct for each text: the base counts, ``base_failed``, ``kept``, how many lines each
    rule removed, ``lost_share`` (noise and navigation, boilerplate aside), ``removed_share`` (all removed
    bytes of all line bytes) and the ``cleaned`` text (without the removed lines)."""
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                          ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()),
                          ("kept", pa.bool_()), ("n_lines", pa.int64()), ("n_punctuation_lines", pa.int64()),
                          ("n_navigation_lines", pa.int64()), ("n_boilerplate_lines", pa.int64()),
                          ("lost_share", pa.float64()), ("removed_share", pa.float64()), ("cleaned", pa.string())])
        for texts in batches:
            parts = [_judge(data, offsets, rules) for _, data, offsets in slices(texts)]
            arrays = []
            for field in kind:
                if field.name == "cleaned":
                    arrays.append(pa.array([x for p in parts for x in p["cleaned"]], pa.binary()).cast(pa.string()))
                else:
                    values = np.concatenate([p[field.name] for p in parts]) if parts else np.zeros(0)
                    arrays.append(pa.array(values.astype(field.type.to_pandas_dtype()), field.type))
            yield pa.StructArray.from_arrays(arrays, fields=list(kind))

    # "not deterministic" only keeps Catalyst from running it once for a filter and once more for a column
    return F.arrow_udf(judged, RESULT).asNondeterministic()(text)


def clean_documents(docs: DataFrame, text_col: str = "text", rules: Rules = DEFAULT_RULES,
                    chars_col: str | None = "n_chars") -> DataFrame:
    """The kept documents with all their columns: the text without removed lines, and its
    number of characters in ``chars_col`` if there is such a column."""
    found = fresh_name("quality", docs.columns)
    judged = docs.withColumn(found, line_quality(F.col(text_col), rules)).where(F.col(f"{found}.kept"))
    new = {text_col: F.col(f"{found}.cleaned")}
    if chars_col in docs.columns:
        new[chars_col] = F.when(F.col(f"{found}.cleaned") == F.col(text_col), F.col(chars_col)).otherwise(
            F.length(f"{found}.cleaned").cast(docs.schema[chars_col].dataType))
    return judged.withColumns(new).select(*docs.columns)
