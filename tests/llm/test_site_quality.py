import math
import random

import pytest
from pyspark.sql import functions as F

from citysense.llm.queries import QUERIES
from citysense.llm.site_quality import STYLE, Evidence, fit_evidence, site_quality, style

from .cases import ODD, clashing

SCHEMA = "doc_id long, text string, lang string, source string"
LABELS = "doc_id long, quality int, toxic int"


def corpus(n=260, seed=6):
    rng, docs, labels = random.Random(seed), [], []
    for i in range(n):
        host = f"h{rng.choice([0, 0, 0, 1, 2, 3, 4])}"
        good = rng.random() < {"h0": 0.9, "h1": 0.2}.get(host, 0.6)
        words = [rng.choice(["plain", "words", "of", "a", "text", "stand", "here"]) for _ in range(rng.randrange(5, 40))]
        text = " ".join(words) + "." if good else " ".join(f"{w}%%% {w.upper()}!!" for w in words)
        if rng.random() < 0.3:
            text = "some words."  # says little by itself
        docs.append((i, text, rng.choice(["en", "de", None]), host if i % 50 else None))
        if i % 2:
            labels.append((i, int(good), 0))
    return docs, labels


def brute(docs, labels, odds):
    """Posteriors by direct sums over the documents."""
    label = dict((i, q) for i, q, _ in labels)
    y = {i: label.get(i, 1 / (1 + math.exp(-odds[i]))) for i, *_ in docs}
    rate = (sum(y.values()) + 1) / (len(docs) + 2)

    def weight(groups, parent):
        n = sum(map(len, groups.values()))
        spread = sum(len(g) * (sum(y[i] for i in g) / len(g) - parent(k)) ** 2 for k, g in groups.items())
        room, chance = n - sum(len(g) ** 2 for g in groups.values()) / n, rate * (1 - rate)
        excess = (spread - max(len(groups) - 1, 0) * chance) / room if room > 0 else 0
        return min(max(chance / excess - 1 if excess > 0 else 1e6, 1), 1e6)

    hosts, paths = {}, {}
    for i, _, lang, host in docs:
        hosts.setdefault(host, []).append(i)
        paths.setdefault((host, lang), []).append(i)
    of_host = {k: sum(y[i] for i in g) / len(g) for k, g in hosts.items()}
    wh, wp = weight(hosts, lambda k: rate), weight(paths, lambda k: of_host[k[0]])
    out = {}
    for i, _, lang, host in docs:
        h, p = hosts[host], paths[host, lang]
        hr = (sum(y[j] for j in h) - y[i] + rate * wh) / (len(h) - 1 + wh)
        pr = (sum(y[j] for j in p) - y[i] + hr * wp) / (len(p) - 1 + wp)
        out[i] = hr, pr, 1 / (1 + math.exp(-(odds[i] + math.log(pr / (1 - pr)) - math.log(rate / (1 - rate)))))
    return out


def test_posteriors_equal_brute_force(spark):
    docs, labels = corpus()
    df, marks = clashing(spark.createDataFrame(docs, SCHEMA)), spark.createDataFrame(labels, LABELS)
    rows = {r.doc_id: r for r in site_quality(df, marks).collect()}
    assert len(rows) == len(docs)
    odds = {i: math.log(r.document_score / (1 - r.document_score)) for i, r in rows.items()}
    want = brute(docs, labels, odds)
    for i, r in rows.items():
        assert (r.host_rate, r.path_rate, r.score) == pytest.approx(want[i], rel=1e-6, abs=1e-9)
        assert r.kept == (r.score >= 0.5)
    assert len({round(r.host_rate, 2) for r in rows.values()}) > 3  # hosts differ, and so they are not shrunk to one rate


def test_held_out_accuracy(spark, tmp_path):
    docs, labels = corpus(600, 9)
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels[:150], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.doc_id: r for r in QUERIES["op6_site_quality"](spark, str(tmp_path)).collect()}
    held = [(i, q) for i, q, _ in labels[150:]]
    assert sum(rows[i].kept == bool(q) for i, q in held) / len(held) > 0.8
    combined = sum(-math.log(rows[i].score if q else 1 - rows[i].score) for i, q in held)
    alone = sum(-math.log(rows[i].document_score if q else 1 - rows[i].document_score) for i, q in held)
    assert combined < alone


def test_edges(spark):
    df = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(ODD)] + [(None, "a", "en", "h"), (0, "a", "en", "h"), (0, "a", "en", "h")], SCHEMA)
    none = spark.createDataFrame([], LABELS)
    rows = site_quality(df, none).collect()
    assert len(rows) == len(ODD) + 3 and all(r.document_score == 0.5 for r in rows)
    ones = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (1, None, 0), (99, 1, 1)], LABELS)
    assert all(r.score > 0.5 for r in site_quality(df, ones).collect())
    assert site_quality(df.where("false"), ones).count() == 0


def test_bounded_training(spark):
    df = spark.createDataFrame([(i, [float(i % 2)] * len(STYLE), i % 2) for i in range(50)], "id long, style array<double>, label int")
    assert isinstance(fit_evidence(df, 20), Evidence)
    assert fit_evidence(df.where("label = 1"), 20).intercept > 0


def test_style(spark):
    df = spark.createDataFrame([("One two two .\nOne two two .\n",), ("",), (None,)], "text string")
    rows = [dict(zip(STYLE, r[0], strict=True)) for r in df.select(style(F.col("text"))).collect()]
    assert rows[0]["words"] == pytest.approx(math.log(9)) and rows[0]["distinct_words"] == pytest.approx(3 / 8)
    assert rows[0]["repeated_lines"] == 0.5 and rows[0]["doubled_words"] == pytest.approx(2 / 8) and rows[0]["finished_lines"] == 1
    assert rows[0]["capitals"] == pytest.approx(2 / 28) and rows[1] == rows[2]


def test_url_prefixes_equal_brute_force(spark):
    """Hosts and three levels of paths from a URL: posteriors by direct sums over the documents."""
    rng, docs, labels = random.Random(9), [], []
    for i in range(200):
        host, folders = f"h{rng.choice([0, 0, 1, 2])}.org", [rng.choice(["a", "b"]) for _ in range(rng.choice([0, 1, 2, 3, 4]))]
        url = None if i % 40 == 7 else f"https://{host.upper()}/" + "/".join([*folders, f"page{i}.html"]) + "?q=1"
        docs.append((i, "some words here.", url))
        labels.append((i, int(rng.random() < (0.9 if "a" in folders[:1] else 0.3)), 0))
    df = spark.createDataFrame(docs, "doc_id long, text string, url string")
    got = {r.doc_id: r for r in site_quality(df, spark.createDataFrame(labels, LABELS), url_col="url", path_levels=3).collect()}
    assert len(got) == len(docs)
    y = {i: q for i, q, _ in labels}
    rate = (sum(y.values()) + 1) / (len(docs) + 2)

    def sites(url):
        if url is None:
            return (None,) * 4
        host, *parts = url[8:].split("?")[0].split("/")
        return tuple("/".join([host.lower(), *parts[:-1][:k]]) for k in range(4))

    groups, weights = [{} for _ in range(4)], []
    for i, _, url in docs:
        own = sites(url)
        for level in range(4):
            groups[level].setdefault(own[:level + 1], []).append(i)
    for level, found in enumerate(groups):
        raw = lambda k, level=level: rate if not level else sum(y[i] for i in groups[level - 1][k[:-1]]) / len(groups[level - 1][k[:-1]])
        n = sum(map(len, found.values()))
        spread = sum(len(g) * (sum(y[i] for i in g) / len(g) - raw(k)) ** 2 for k, g in found.items())
        room, chance = n - sum(len(g) ** 2 for g in found.values()) / n, rate * (1 - rate)
        excess = (spread - max(len(found) - 1, 0) * chance) / room if room > 0 else 0
        weights.append(min(max(chance / excess - 1 if excess > 0 else 1e6, 1), 1e6))
    for i, _, url in docs:
        above, own, want = rate, sites(url), []
        for level in range(4):
            g = groups[level][own[:level + 1]]
            above = (sum(y[j] for j in g) - y[i] + above * weights[level]) / (len(g) - 1 + weights[level])
            want.append(above)
        assert got[i].rates == pytest.approx(want, abs=1e-9) and got[i].path_rate == pytest.approx(want[-1], abs=1e-9)
