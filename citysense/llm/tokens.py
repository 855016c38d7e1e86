"""Token ids on the workers, from the vocabulary files of public tokenizers.

The files stay where they are installed; a tokenizer is named by its paths. Ids
are those of the ``tokenizers`` library for the JSON file. The same vocabulary
as ranks lets ``tiktoken`` find them about four times as fast; where its
regular expressions give up (blanks by the hundred thousand), the JSON file's
tokenizer is used. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import base64
import os
from dataclasses import dataclass
from functools import lru_cache

import numpy as np


@dataclass(frozen=True)
class TokenizerFiles:
    """Paths on every worker; None: those of the installed package of public tokenizers."""

    json_path: str | None = None
    ranks_path: str | None = None


class Encoder:
    def __init__(self, files: TokenizerFiles):
        import public_tokenizers
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark gives each worker its core
        self.json_path = files.json_path or public_tokenizers.path("byte_bpe_50k.json")
        with open(files.ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self._fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        #: UTF-8 bytes of each id
        self.widths = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
        for token, rank in ranks.items():
            self.widths[rank] = len(token)

    def ids(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, dtype=np.uint32)
        try:
            return self._fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:
            return np.array(_slow(self.json_path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)


@lru_cache(maxsize=1)
def _slow(path: str):
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


@lru_cache(maxsize=2)
def encoder(files: TokenizerFiles) -> Encoder:
    """One for each worker process."""
    return Encoder(files)
