"""Encoded texts for the operators that count and pack tokens.

The ids are those of the vocabulary file read by ``tokenizers``. Ordinary texts
go through ``tiktoken`` with the same vocabulary as ranks, several times as
fast; texts with characters on which the two libraries' Unicode tables can
differ go through ``tokenizers`` itself, and very long ones through the
transducer of ``bpe``, which needs linear time whatever the text.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import regex
import tiktoken

from .bpe import _FULL, Encoder, read_ranks

VOCABULARY = "byte_bpe_50k.json"
LONG = 100_000

#: Letters and numbers of scripts whose tables have long been settled, and all
#: punctuation and spaces below U+2E80; anything else is left to the library.
_SETTLED = regex.compile(r"[\x00-՗ऀ-ॣ‐-⁯₠-₿←-⏿─-➿　-ヿ一-龥가-힣]*+")


@lru_cache(maxsize=1)
def _library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(maxsize=1)
def _slow(path: str, special: tuple[str, int] | None) -> Encoder:
    return Encoder(path, special)


@lru_cache(maxsize=1)
def ids_of(path: str | None = None) -> Callable[[str], np.ndarray]:
    """A function from a text to its ids, without special tokens being added.

    The two other ways are only loaded where a text needs them: a worker's memory
    otherwise holds three copies of the vocabulary.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    with open(path, encoding="utf-8") as f:
        special = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens=special)
    names = set(special)

    def ids(text: str) -> np.ndarray:
        if not text.isascii() and _SETTLED.match(text).end() < len(text):
            return np.array(_library(path).encode(text, add_special_tokens=False).ids, np.uint32)
        if len(text) > LONG and len(special) < 2 and max(map(len, _FULL.findall(text))) > 1000:
            return np.frombuffer(_slow(path, next(iter(special.items()), None)).packed_ids(text), "<u4")
        return fast.encode_to_numpy(text, allowed_special=names)

    return ids
