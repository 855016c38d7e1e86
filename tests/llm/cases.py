"""Texts that every text operator must handle, and small helpers for the tests."""

from __future__ import annotations

import random

import public_tokenizers
from tokenizers import Tokenizer

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

ODD = [
    None, "", " ", "\n\n", "one", "\t\x0b\x0c\r", "é", "ÀÉ àé ÀÉ", "a\x1cb \x85   c d", "\U0001f600 \U0001f600 x",
    "K K k ſ s S", "x" * 3000, "a b c d e " * 400, "A b\na b\nA b\n\nA b", "\x00\x01 \x7f !", "a,b.c 9 z Z9",
    "line one.\nline one.\nline two.", "Home | About | Contact | Login\nA sentence of quite ordinary words stands here today.",
]


def random_texts(n: int, seed: int = 5, words: int = 60) -> list[str]:
    """Texts over a small vocabulary, so that windows repeat, with all sorts of separators."""
    rng = random.Random(seed)
    vocabulary = ["the", "The", "a", "né", "of", "x1", "to", "on", "it", "is", "was", "die", "und", "ß", "that", "nt."]
    out = []
    for _ in range(n):
        size = rng.choice([1, 3, 9, 10, 11, words, words * 4])
        sep = rng.choice([" ", " ", "\n", "  ", "\t"])
        out.append("".join(rng.choice(vocabulary) + (sep if rng.random() < 0.3 else " ") for _ in range(size)))
    return out


def rows(texts: list) -> list[tuple]:
    return [(i, t, "en", f"src{i % 3}", None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, texts: list):
    return spark.createDataFrame(rows(texts), SCHEMA)


def clashing(df):
    """With extra columns named as operators name their own."""
    extra = ["id", "size", "key", "part", "quality", "shard", "row", "words", "fingerprint", "spans", "hits", "row_", "value"]
    from pyspark.sql import functions as F
    return df.withColumns({x: F.lit("extra") for x in extra})


def write_tables(spark, folder, texts, benchmark=()):
    frame(spark, texts).write.mode("overwrite").parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, t) for i, t in enumerate(benchmark)], "item_id long, text string").write.mode(
        "overwrite").parquet(f"{folder}/benchmark.parquet")
    return str(folder)


#: Blanks of all kinds, and a special token's string as ordinary text.
BLANKS = ["a  b", "a \n b", " lead", "trail  ", "a\n\nb \t c", "x　y 　z", "it's he'll 12 34!? ¿qué?", "<|endoftext|> a<|endoftext|>", " " * 200_000 + "x"]


def library_tokenizer():
    """The tokenizers library's own encoder, with special-token strings as ordinary text."""
    out = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out.encode_special_tokens = True
    return out


def library_ids():
    tokenizer = library_tokenizer()
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids
