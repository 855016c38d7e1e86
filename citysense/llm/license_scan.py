"""Operator 11: license scan by ordered signature rules.

Hundreds of hand-written regular expressions (``license_rules``) run over
normalised words. *Prefilter:* the words of a slice of texts are hashed with
numpy and looked up among the anchor words of all rules; a text without an
anchor meets no regular expression. Around anchors, stretches of words are cut
that hold every possible match (no rule spans more than ``LONGEST`` words); in
a stretch only those rules run whose anchors and other needed words occur there.

*Overlaps.* Detections are ranked by priority, then length, then place, then
the order of the rules. One that lies within the interval of a better ranked
one is dropped (interval containment); overlapping ones that contain each other
in no way both stay. Base phrases are never dropped.

Texts are read in place by an Arrow column function; nothing is shuffled,
whole texts are scanned, and memory follows a slice of about 2 MB.

Defined results: null and empty texts have no words, no detections and the
score 0; repeated rows are scanned one by one; an empty table gives no rows;
other columns are untouched.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .license_rules import LONGEST, RULES, Rule
from .textbytes import PLAIN_WORDS, slices

RESULT = "struct<n_words:long,found:array<struct<label:string,rule:string,start:long,end:long,base:boolean>>,score:double>"
_FOUND = pa.list_(pa.struct([("label", pa.string()), ("rule", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

#: A detection: (start word, end word, number of the rule).
Detection = tuple[int, int, int]


class Scanner:
    def __init__(self, rules: list[Rule]):
        self.rules = rules
        self.by_anchor: dict[str, list[int]] = {}
        for n, rule in enumerate(rules):
            for word in rule.anchors:
                self.by_anchor.setdefault(word, []).append(n)
        words = sorted(self.by_anchor)
        data = np.frombuffer("".join(words).encode(), dtype=np.uint8)
        edges = np.cumsum([0] + [len(w.encode()) for w in words])
        self.anchors = np.sort(PLAIN_WORDS.hashes(data, edges[:-1], edges[1:]))
        self.in_stretch = lru_cache(maxsize=2_000)(self._matches)

    def _matches(self, text: str) -> tuple[Detection, ...]:
        """All detections in a stretch of normalised words."""
        words = text.split(" ")
        present, out = set(words), []
        starts = np.cumsum([0] + [len(w) + 1 for w in words]).tolist()
        for n in sorted({n for w in present if w in self.by_anchor for n in self.by_anchor[w]}):
            rule = self.rules[n]
            if all(any(w in present for w in some) for some in rule.needs):
                out += [(bisect_right(starts, m.start()) - 1, bisect_right(starts, m.end() - 1), n) for m in rule.regex.finditer(text)]
        return tuple(out)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, list[Detection]]]:
        """Word counts, and the detections of each document that has some."""
        starts, ends, bounds = PLAIN_WORDS.find(data, offsets)
        hashes = PLAIN_WORDS.hashes(data, starts, ends)
        place = np.minimum(np.searchsorted(self.anchors, hashes), len(self.anchors) - 1)
        at = np.flatnonzero(self.anchors[place] == hashes)
        owner = np.searchsorted(bounds, at, side="right") - 1
        low, high = np.maximum(at - LONGEST, bounds[owner]), np.minimum(at + LONGEST + 1, bounds[owner + 1])
        # anchors whose stretches touch share one
        new = np.ones(len(at), dtype=bool)
        new[1:] = (owner[1:] != owner[:-1]) | (low[1:] > high[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at))[: len(first)] - 1
        text, out = data.tobytes(), {}
        for a, b in zip(first, last, strict=True):
            lo, hi, i = int(low[a]), int(high[b]), int(owner[a])
            words = b" ".join(text[starts[k]:ends[k]] for k in range(lo, hi)).lower().decode()
            found = self.in_stretch(words) if len(words) < 4_000 else self._matches(words)
            if found:
                out.setdefault(i, []).extend((s + lo - int(bounds[i]), e + lo - int(bounds[i]), n) for s, e, n in found)
        return np.diff(bounds), {i: self.resolve(found) for i, found in out.items()}

    def resolve(self, found: list[Detection]) -> list[Detection]:
        """Drop what lies within a better ranked detection, base phrases aside; in order of place."""
        rank = lambda d: (-self.rules[d[2]].priority, d[0] - d[1], d[0], d[2])
        reach: dict[int, int] = {}  # for each start, how far a kept detection reaches; none is longer than LONGEST words
        kept = []
        for d in sorted(found, key=rank):
            inside = any(reach.get(s, -1) >= d[1] for s in range(d[0] - LONGEST, d[0] + 1))
            if inside and not self.rules[d[2]].base:
                continue
            kept.append(d)
            reach[d[0]] = max(reach.get(d[0], -1), d[1])
        return sorted(kept)


@lru_cache(maxsize=1)
def _scanner() -> Scanner:
    """One for each worker process."""
    return Scanner(RULES)


def license_scan(text: Column) -> Column:
    """A struct for each text: ``n_words``; ``found``, the detections (label, rule, start and end word,
    whether of a base phrase) by place; ``score``, the confidence (0 to 1) of the surest of them."""
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scanner = _scanner()
        for texts in batches:
            counts, found, scores = [], [[]] * len(texts), np.zeros(len(texts))
            for first, data, offsets in slices(texts):
                n_words, hits = scanner.scan(data, offsets)
                counts.append(n_words)
                for i, own in hits.items():
                    rules = [scanner.rules[n] for _, _, n in own]
                    found[first + i] = [{"label": r.label, "rule": r.name, "start": s, "end": e, "base": r.base}
                                        for (s, e, _), r in zip(own, rules, strict=True)]
                    scores[first + i] = max(r.confidence for r in rules)
            yield pa.StructArray.from_arrays(
                [pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(found, _FOUND), pa.array(scores)],
                names=["n_words", "found", "score"])

    return F.arrow_udf(scanned, RESULT).asNondeterministic()(text)


def labels_of(found: Column) -> Column:
    """The distinct labels of detections, sorted, comma-joined."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")
