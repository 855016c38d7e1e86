import random
import re
import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest

from citysense.llm.kneser_ney import _pack, _tokens, _unpack, discounts, score_held_out, token_probabilities, train
from citysense.llm.queries import QUERIES
from citysense.llm.textbytes import slices

from .cases import ODD, clashing, frame, random_texts, write_tables


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall("[^\x20\x09-\x0d]+", low), "</s>"]


class Brute:
    """The same model over dictionaries of strings."""

    def __init__(self, texts, order):
        self.order, self.raw = order, Counter()
        counts = Counter()
        for t in texts:
            w = tokens(t)
            self.raw.update(w)
            padded = ["<s>"] * (order - 1) + w
            counts.update(tuple(padded[i:i + order]) for i in range(len(w)))
        self.levels = {order: counts}
        for k in range(order - 1, 0, -1):
            below = Counter()
            for g, c in self.levels[k + 1].items():
                below[g[1:]] += c if g[1] == "<s>" else 1
            self.levels[k] = below
        self.d, self.context = {}, {}
        for k, level in self.levels.items():
            self.d[k] = discounts([sum(c == j for c in level.values()) for j in (1, 2, 3, 4)])
            followers = defaultdict(Counter)
            for g, c in level.items():
                followers[g[:-1]][g[-1]] = c
            self.context[k] = followers

    def p(self, w, before):
        out = 1 / (len(self.raw) + 1)
        for k in range(1, self.order + 1):
            context = tuple(before[len(before) - k + 1:]) if k > 1 else ()
            follow = self.context[k].get(context)
            if not follow:
                continue
            d, c = self.d[k], follow[w]
            own = max(c - (0.0, *d)[min(c, 3)], 0)
            out = (own + sum(d[min(x, 3) - 1] for x in follow.values()) * out) / sum(follow.values())
        return out

    def score(self, text):
        w = ["<s>"] * (self.order - 1) + tokens(text)
        return sum(log10(self.p(w[i], w[i - self.order + 1:i])) for i in range(self.order - 1, len(w)))

    def base(self, text):
        n = sum(self.raw.values())
        return sum(log10((self.raw[w] + 1) / (n + len(self.raw) + 1)) for w in tokens(text))


def is_held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def compare(rows, texts, order):
    model = Brute([t for i, t in enumerate(texts) if not is_held(i)], order)
    assert len(rows) == len(texts)
    for r in rows:
        w = tokens(texts[r.doc_id])
        assert (r.held_out, r.n_tokens, r.n_known) == (is_held(r.doc_id), len(w), sum(x in model.raw for x in w))
        assert r.train_tokens == sum(model.raw.values())
        assert r.base_score == pytest.approx(model.base(texts[r.doc_id]), rel=1e-9)
        assert r.score == pytest.approx(model.score(texts[r.doc_id]), rel=1e-6), (r.doc_id, order)


def test_query_equals_brute_force(spark, tmp_path):
    texts = [t for t in ODD if not t or len(t) < 1000] + random_texts(80)
    compare(QUERIES["op2_kneser_ney"](spark, write_tables(spark, tmp_path, texts)).collect(), texts, 2)


@pytest.mark.parametrize("order", [1, 3])
def test_other_orders(spark, order):
    texts = random_texts(60) + [None, "", "one"]
    compare(score_held_out(clashing(frame(spark, texts)), order=order).collect(), texts, order)


def test_many_shards_and_chunks_give_the_same(spark):
    texts = random_texts(60)
    df = frame(spark, texts).repartition(5)
    whole = {r.doc_id: r.score for r in train(df).score(df).collect()}
    model = train(df, shard_bytes=200, chunk_tokens=50)
    assert model.bits >= 5 and len(model.files["gram2"]) > 10
    split = {r.doc_id: r.score for r in model.score(df).collect()}
    assert split == pytest.approx(whole)
    model.delete()


def test_probabilities_add_up_to_one(spark):
    texts = random_texts(40)
    for order in (2, 3):
        model = train(frame(spark, texts), order=order)
        brute = Brute(texts, order)
        vocabulary = list(brute.raw)
        for before in ("", "the a", "né of", "never seen"):
            import pyarrow as pa
            array = pa.array([f"{before} {w}".replace("</s>", "") for w in vocabulary] + [f"{before} unknownword"])
            got = 0.0
            for _, data, offsets in slices(array):
                ids, begins = _tokens(data, offsets)
                p, _ = token_probabilities(model, ids, begins)
                for i, w in enumerate([*vocabulary, "unknownword"]):
                    got += p[begins[i + 1] - 1 if w == "</s>" else begins[i + 1] - 2]
            assert got == pytest.approx(1.0)
        assert sum(brute.p(w, ["the", "a"]) for w in [*vocabulary, "?"]) == pytest.approx(1.0)


def test_held_out_texts_are_scored_better_than_by_the_base(spark):
    rng = random.Random(8)
    follow = {w: rng.sample(range(60), 3) for w in range(60)}
    texts = []
    for _ in range(300):
        w, out = rng.randrange(60), []
        for _ in range(40):
            out.append(f"w{w}")
            w = rng.choice(follow[w])
        texts.append(" ".join(out))
    rows = [r for r in score_held_out(frame(spark, texts)).collect() if r.held_out]
    assert rows and sum(r.score for r in rows) > 0.5 * sum(r.base_score for r in rows)


def test_packing_arrays():
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 2**64, 50, dtype=np.uint64)[rng.integers(0, 50, 200)] for _ in range(3)]
    values = [rng.integers(1, 2**40, 200)]
    w, v = _unpack(_pack(words, values))
    rows = lambda columns: sorted(zip(*(c.tolist() for c in columns), strict=True))
    assert rows(w + v) == rows(words + values)


def test_edges(spark):
    df = frame(spark, ["a b", "a b"])
    rows = score_held_out(df.where("false")).collect()
    assert rows == []
    held = next(i for i in range(100) if is_held(i))
    only = spark.createDataFrame([(held, "a b"), (held, None)], "doc_id long, text string")
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in score_held_out(only).collect()] == [(3, 0, 0, 0, 0), (1, 0, 0, 0, 0)]
    null = spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string")
    assert [(r.held_out, r.train_tokens) for r in score_held_out(null).collect()] == [(False, 6)] * 2
    with pytest.raises(ValueError):
        train(df, order=0)


def test_discounts():
    assert discounts([0, 5, 1, 1]) == (0.5, 1.0, 1.5)
    d = discounts([100, 40, 20, 10])
    assert 0 < d[0] < 1 and d[0] < d[1] < 2 and d[1] < d[2] < 3


def test_open_files_are_bounded(spark, monkeypatch):
    """Many shards, few of them open at once; lookups and scores stay the same, mapped or read."""
    from citysense.llm import kneser_ney as kn
    docs = frame(spark, random_texts(60))
    model = kn.train(docs, order=2, shard_bytes=256)
    assert 1 << model.bits >= 16
    texts = kn.pa.array(random_texts(60))
    _, data, offsets = next(iter(kn.slices(texts)))
    tokens, begins = kn._tokens(data, offsets)
    whole = kn.token_probabilities(model, tokens, begins)
    real = kn._read
    for read, limits in ((real, (8, 1 << 20)), (lambda *a: np.array(real(*a)), (8, 4_000))):
        held, most = kn._Open(*limits), [0]

        def count(*a, read=read, held=held, most=most):
            most[0] = max(most[0], held.mapped)
            return read(*a)

        monkeypatch.setattr(kn, "_read", count)
        monkeypatch.setattr(kn, "_OPEN", held)
        again = kn.token_probabilities(model, tokens, begins)
        assert all((a == b).all() for a, b in zip(whole, again, strict=True))
        assert most[0] <= 8 + 5 and held.mapped <= 8 and (held.read <= 4_000 or len(held.held) == 1)
    model.delete()
