import re

from citysense.llm.license_rules import FAMILIES, LONGEST, PHRASES, RULES
from citysense.llm.license_scan import license_scan
from citysense.llm.queries import QUERIES

from .cases import ODD, clashing, frame, random_texts, write_tables

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


#: Compiled once: there are more rules than the cache of ``re`` holds.
COMPILED = [re.compile(f"(?<![^ ])(?:{rule.pattern})(?![^ ])") for rule in RULES]


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text):
    """Every rule over the whole text, without prefilter; containment by comparing all pairs."""
    own = words(text)
    whole = " ".join(own)
    places = [i for i, c in enumerate(whole) if i == 0 or whole[i - 1] == " "]
    found = []
    for n, rule in enumerate(RULES):
        for m in COMPILED[n].finditer(whole):
            start, end = places.index(m.start()), sum(p < m.end() for p in places)
            found.append(((-rule.priority, start - end, start, n), start, end, rule))
    found.sort(key=lambda x: x[0])
    kept = []
    for i, (_, s, e, rule) in enumerate(found):
        if rule.base or not any(a <= s and b >= e and k < i for k, (_, a, b, _) in enumerate(found[:i])):
            kept.append((s, e, rule))
    base = [s for s, _, r in kept if r.base]
    return {"n_words": len(own), "n_base": len(base), "first_word": min(base, default=None), "last_word": max(base, default=None),
            "base_labels": ",".join(sorted({r.label for _, _, r in kept if r.base})), "labels": ",".join(sorted({r.label for _, _, r in kept})),
            "score": max((r.confidence for _, _, r in kept), default=0.0)}


NOTICES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "Licensed under CC BY-NC 4.0.", "cc-by-nc-sa 3.0", "CC BY 4.0",
    "This work is licensed under the GNU General Public License, version 3.", "GNU Affero General Public License v3 or later", "LGPL-2.1",
    "SPDX-License-Identifier: GPL-2.0-only", "SPDX-License-Identifier: MIT", "https://www.gnu.org/licenses/gpl-3.0.html", "https://opensource.org/licenses/MIT",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "Mozilla Public License, version 2.0", "BSD 3-Clause License", "the 2-clause BSD license", "public domain dedication", "All rights reserved.",
    "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "creativecommons.org/licenses/by-sa/4.0", "ISC License", "WTFPL v2",
    "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "mit license apache license version 2 cc by nc", "Eclipse Public License 2.0", "sold under the mit Licence", "SIL Open Font License 1.1", "OpenRAIL license",
]


def texts():
    fill = "word " * (LONGEST + 5)
    return [*ODD, *NOTICES, *[f"{fill}{x} {fill}" for x in NOTICES], " ".join(NOTICES), "\n".join(NOTICES * 3), "under the mit license " * 30,
            *[f"{a} {b}" for a, b in zip(random_texts(20), NOTICES, strict=False)], "cc by nc" + " by nc" * 3, fill + "under the\u2028mit license"]


def test_query_equals_brute_force(spark, tmp_path):
    every = texts()
    rows = {r.doc_id: r.asDict() for r in QUERIES["op11_license_scan"](spark, write_tables(spark, tmp_path, every)).collect()}
    assert len(rows) == len(every)
    for i, t in enumerate(every):
        assert rows[i] == {"doc_id": i, **brute(t)}, repr(t)[:100]


LABELS = [
    ("Released under the MIT License.", {"mit"}), ("GPL-3.0-or-later", {"gpl-3"}), ("under GNU Lesser General Public License version 2.1", {"lgpl-2.1"}),
    ("SPDX-License-Identifier: Apache-2.0", {"apache-2"}), ("Creative Commons Attribution-ShareAlike 4.0 license", {"cc-by-sa"}),
    ("Mozilla Public License 2.0", {"mpl-2.0"}), ("new BSD license", {"bsd-3-clause"}), ("the quick brown fox", set()), ("wir gehen mit", set()),
    ("Licensed under CC BY-NC-ND 4.0 and nothing else", {"cc-by-nc", "cc-by-nc-nd"}),
]


def test_labels(spark):
    rows = frame(spark, [t for t, _ in LABELS]).select("doc_id", license_scan("text").alias("s")).collect()
    for r in rows:
        want = LABELS[r.doc_id][1]
        assert {d.label for d in r.s.found} == want and (r.s.score > 0) == bool(want), LABELS[r.doc_id]


def test_rules_are_bounded_and_gated():
    assert len(RULES) >= 300 and len({r.name for r in RULES}) == len(RULES) and len(FAMILIES) > 60
    assert all(r.anchors and r.regex for r in RULES) and not any(re.search(r"(?<!\\)[*+]", r.pattern.replace("[^ ]+ ", "")) for r in RULES)
    assert not any("mit" in r.anchors for r in RULES)  # an everyday word elsewhere
    assert [r.pattern for r in RULES if r.base] == [p for _, p, _ in PHRASES]


def test_odd_tables(spark):
    df = clashing(frame(spark, ["MIT License", None, ""]))
    got = df.withColumn("s", license_scan("text"))
    assert got.columns == [*df.columns, "s"]
    assert [(r.s.n_words, len(r.s.found), r.s.score) for r in got.orderBy("doc_id").collect()] == [(2, 1, 0.6), (0, 0, 0.0), (0, 0, 0.0)]
    assert df.where("false").withColumn("s", license_scan("text")).count() == 0
