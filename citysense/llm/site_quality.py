"""Operator 6: document quality by hierarchical empirical Bayes over hosts and paths.

1. *Document evidence.* A worker measures the style of each text (an Arrow UDF);
   a logistic regression fitted on labelled documents turns it into log odds.
2. *Sites.* Every document counts for its host and for the paths below it (one
   column, or the prefixes of a URL level by level): with its label if it
   has one, else with its probability. Counts come from grouped
   aggregations with map-side partial sums (one for each level), so a host with a third of all rows
   is one row for each task.
3. *Shrinkage.* How much hosts differ from the global rate, and paths from their
   host, beyond what chance explains, is estimated by moments over all sites;
   from this follow the weights (pseudo-counts) of the two priors. A host's
   posterior is shrunk to the global rate, a path's to its host's posterior: a
   site with few documents says what its parent says.
4. *Combination.* A document's log odds are moved by how far its path's
   posterior lies from the global rate. Its own count is taken out of path and
   host first, so its evidence is not used twice.

The regression is fitted on at most ``max_train`` labelled documents, those of
the least id hash (a documented bound); counts, priors and posteriors use all
documents. Only numbers are joined and shuffled, never texts. Site rows are
joined by key (adaptive joins split a hot host), not broadcast by hint.

Defined results: a null or empty text has the style of no words; null hosts and
paths are sites of their own; repeated documents each count; of repeated labels
of an id the largest counts; without labels, or with one class only, the
evidence is the smoothed label rate alone; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import materialize
from .textbytes import BLANK_WORDS, LINES, PLAIN_WORDS, covered, per_document, seen_in_document, slices, windows

STYLE = ("words", "word_length", "symbols", "signs", "digits", "capitals", "shouts", "bars", "repeated_windows",
         "repeated_lines", "distinct_words", "doubled_words", "finished_lines", "line_length")
MAX_TRAIN = 20_000
#: Pseudo-counts of a prior are kept between these.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e6


def _class(values: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(values)] = True
    return out


_SYMBOLS, _SHOUTS, _BARS, _STOPS = _class(b"#*$%&<>"), _class(b"!?"), _class(b"|"), _class(b".!?:;\"')")
_DIGITS, _CAPITALS = _class(b"0123456789"), _class(bytes(range(65, 91)))
_SIGNS = ~(PLAIN_WORDS.inside | _class(b" \t\n\x0b\x0c\r"))
_LEADING = np.array([b & 0xC0 != 0x80 for b in range(256)])


def _style(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n_docs = len(offsets) - 1
    starts, ends, bounds = BLANK_WORDS.find(data, offsets)
    hashes, n = BLANK_WORDS.hashes(data, starts, ends), np.diff(bounds)
    owner = np.repeat(np.arange(n_docs), n)
    count = lambda table: per_document(table[data], offsets)
    words, points = np.maximum(n, 1), np.maximum(count(_LEADING), 1)
    _, again = seen_in_document(hashes, owner)
    doubled = np.zeros(len(hashes), dtype=bool)
    doubled[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    found, at = windows(hashes, bounds, 5)
    twice, _ = seen_in_document(found, owner[at])
    first, last, line_bounds = LINES.find(data, offsets)
    lines = np.maximum(np.diff(line_bounds), 1)
    _, line_again = seen_in_document(LINES.hashes(data, first, last), np.repeat(np.arange(n_docs), np.diff(line_bounds)))
    return np.stack([
        np.log1p(n), per_document(BLANK_WORDS.inside[data] & _LEADING[data], offsets) / words, count(_SYMBOLS) / points,
        count(_SIGNS) / points, count(_DIGITS) / points, count(_CAPITALS) / points, count(_SHOUTS) / words, count(_BARS) / words,
        per_document(covered(at[twice], 5, len(hashes)), bounds) / words, per_document(line_again, line_bounds) / lines,
        1 - per_document(again, bounds) / words, per_document(doubled, bounds) / words,
        per_document(_STOPS[data[last - 1]], line_bounds) / lines, np.log1p(n / lines)], axis=1)


def style(text: Column) -> Column:
    """An array of numbers about each text, in the order of ``STYLE``."""
    def measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            rows = [_style(data, offsets) for _, data, offsets in slices(texts)]
            flat = np.concatenate(rows).ravel() if rows else np.zeros(0)
            yield pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, len(STYLE), dtype=np.int32), pa.array(flat, pa.float64()))

    return F.arrow_udf(measure, "array<double>").asNondeterministic()(text)


@dataclass(frozen=True)
class Evidence:
    """Log odds = intercept + weights . style."""

    weights: tuple[float, ...]
    intercept: float

    def log_odds(self, values: Column) -> Column:
        out = F.lit(self.intercept)
        for i, w in enumerate(self.weights):
            out = out + values[i] * w
        return out


def fit_evidence(labelled: DataFrame, max_train: int = MAX_TRAIN) -> Evidence:
    """From rows (id, style, label 0/1); at most ``max_train`` of them, those of the least id hash."""
    train = materialize(labelled.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(max_train)
                        .select(array_to_vector("style").alias("features"), F.col("label").cast("double").alias("label")))
    n, ones = train.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or ones in (0, n):
        rate = ((ones or 0) + 1) / (n + 2)
        return Evidence((0.0,) * len(STYLE), float(np.log(rate / (1 - rate))))
    model = LogisticRegression(maxIter=50, regParam=1e-3).fit(train)
    return Evidence(tuple(float(w) for w in model.coefficients), float(model.intercept))


def _prior_weight(rate: float, spread: float, sites: float, n: float, n_squares: float) -> float:
    """Pseudo-counts from the weighted spread of the sites' rates about their parent's."""
    chance = rate * (1 - rate)
    room = n - n_squares / n if n else 0.0
    excess = (spread - max(sites - 1, 0) * chance) / room if room > 0 else 0.0
    weight = chance / excess - 1 if excess > 0 else MOST_WEIGHT
    return float(min(max(weight, LEAST_WEIGHT), MOST_WEIGHT))


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def url_sites(url: Column, path_levels: int = 2) -> list[Column]:
    """The host of a URL, and the host with its first one, two, ... path segments; the last one is never part of
    a site, as it names the document. Null where there is no host."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    parts = F.filter(F.split(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), "/"), lambda x: x != "")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    return [host, *[F.when(host.isNotNull(), F.array_join(F.concat(F.array(host), F.slice(folders, 1, k)), "/")) for k in range(1, path_levels + 1)]]


def site_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                 path_col: str = "lang", label_col: str = "quality", max_train: int = MAX_TRAIN, threshold: float = 0.5,
                 url_col: str | None = None, path_levels: int = 2) -> DataFrame:
    """One row for each document: the id, ``document_score`` (probability from the text alone),
    ``host_docs``, ``host_rate`` (the host's posterior), ``path_docs``, ``path_rate`` (the deepest path's; all without
    the document itself), ``score`` (combined) and ``kept`` (score at or above the threshold), and with a URL
    ``rates``, the posteriors of all levels.

    With ``url_col`` host and paths are the prefixes of the URL, ``path_levels`` below the host; otherwise there is
    one level of paths, ``path_col``."""
    sites = [F.col(host_col), F.col(path_col)] if url_col is None else url_sites(F.col(url_col), path_levels)
    names = [f"site{i}" for i in range(len(sites))]
    measured = materialize(docs.select(F.col(id_col).alias("id"), *[c.alias(n) for c, n in zip(sites, names, strict=True)], style(F.col(text_col)).alias("style")))
    known = labels.where(F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).alias("label"))
    marked = measured.join(known, "id", "left")
    evidence = fit_evidence(marked.where("label IS NOT NULL"), max_train)
    odds = evidence.log_odds(F.col("style"))
    scored = materialize(marked.select(
        "id", *names, odds.alias("odds"), F.coalesce(F.col("label").cast("double"), 1 / (1 + F.exp(-odds))).alias("y")))

    def totals(rows: DataFrame, level: int, good: Column, n: Column) -> DataFrame:
        return materialize(rows.groupBy(*names[:level + 1]).agg(F.sum(good).alias(f"good{level}"), F.sum(n).alias(f"docs{level}")))

    # from the deepest level up, each from the one below
    tables = [totals(scored, len(names) - 1, F.col("y"), F.lit(1).cast("long"))]
    for level in reversed(range(len(names) - 1)):
        tables.insert(0, totals(tables[0], level, F.col(f"good{level + 1}"), F.col(f"docs{level + 1}")))
    good, n = tables[0].agg(F.sum("good0"), F.sum("docs0")).first()
    rate = ((good or 0.0) + 1) / ((n or 0) + 2)

    def same(level: int) -> Column:
        out = F.lit(True)
        for name in names[:level + 1]:
            out = out & F.col(name).eqNullSafe(F.col(f"of_{name}"))
        return out

    # each site with the sums of all sites above it, and each level's weight
    chain, weights = None, []
    for level, rows in enumerate(tables):
        if chain is not None:
            rows = materialize(rows.join(chain, same(level - 1)).drop(*[f"of_{x}" for x in names[:level]]))
        parent = F.lit(rate) if not level else F.col(f"good{level - 1}") / F.col(f"docs{level - 1}")
        k = F.col(f"docs{level}")
        row = rows.agg(F.sum(k * (F.col(f"good{level}") / k - parent) ** 2), F.count(F.lit(1)), F.sum(k), F.sum(k * k)).first()
        weights.append(_prior_weight(rate, *(float(x or 0) for x in row)))
        chain = rows.withColumnsRenamed({x: f"of_{x}" for x in names[:level + 1]})

    out = scored.join(chain, same(len(names) - 1)).select("id", "odds", "y", *[f"{x}{i}" for i in range(len(names)) for x in ("good", "docs")])
    above = F.lit(rate)
    for level, weight in enumerate(weights):
        out = out.withColumn(f"rate{level}", (F.col(f"good{level}") - F.col("y") + above * weight) / (F.col(f"docs{level}") - 1 + weight))
        above = F.col(f"rate{level}")
    last = len(names) - 1
    score = 1 / (1 + F.exp(-(F.col("odds") + _logit(F.least(F.greatest(f"rate{last}", F.lit(1e-6)), F.lit(1 - 1e-6)))
                             - float(np.log(rate / (1 - rate))))))
    rates = [] if url_col is None else [F.array(*[f"rate{i}" for i in range(len(names))]).alias("rates")]
    return out.select(F.col("id").alias(id_col), (1 / (1 + F.exp(-F.col("odds")))).alias("document_score"), F.col("docs0").alias("host_docs"),
                      F.col("rate0").alias("host_rate"), F.col(f"docs{last}").alias("path_docs"), F.col(f"rate{last}").alias("path_rate"),
                      score.alias("score"), (score >= threshold).alias("kept"), *rates)
