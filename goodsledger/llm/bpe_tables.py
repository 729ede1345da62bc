"""Loading of the public byte-level BPE vocabulary. Its path is a parameter; the file is never copied."""

from __future__ import annotations

import base64
import json
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import regex
import tiktoken

RANKS, TOKENIZER = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"


def ranks_path() -> str:
    return public_tokenizers.path(RANKS)


def added_tokens(path: str | None = None) -> dict[str, int]:
    """Marks that the tokenizer file names beside its vocabulary, with their ids."""
    with open(path or public_tokenizers.path(TOKENIZER), encoding="utf-8") as file:
        return {token["content"]: token["id"] for token in json.load(file)["added_tokens"]}


def rank_file(path: str) -> bytes:
    """The rank file as it is: some 1 MB whatever the corpus, so it may be broadcast."""
    with open(path, "rb") as file:
        return file.read()


def token_bytes(ranks: bytes) -> dict[bytes, int]:
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines())}


@lru_cache(maxsize=2)
def encoding(ranks: bytes, pattern: str = public_tokenizers.PATTERN) -> tiktoken.Encoding:
    """One per Python worker, kept between tasks."""
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=token_bytes(ranks), special_tokens={})


@lru_cache(maxsize=2)
def splitter(pattern: str = public_tokenizers.PATTERN) -> regex.Pattern:
    return regex.compile(pattern)


def encode_word(coder: tiktoken.Encoding, word: str) -> list[int]:
    """Ids of one match of the pattern. The merges need no second split."""
    return coder._encode_single_piece(word)


#: Characters up to which the encoder's own splitter is used; its stack does not hold for any length.
SPLIT_LIMIT = 200_000


def encode_text(coder: tiktoken.Encoding, text: str, pattern: str = public_tokenizers.PATTERN) -> list[int]:
    """Ids of a whole text. Both ways give the same ids; very long texts are split by the other engine."""
    if len(text) <= SPLIT_LIMIT:
        return coder.encode_ordinary(text)
    return [i for word in splitter(pattern).finditer(text) for i in encode_word(coder, word.group())]


def encode_marked(coder: tiktoken.Encoding, text: str, marks: dict[str, int]) -> list[int]:
    """Ids of a whole text in which ``marks`` are tokens: it is cut at them, leftmost and longest, before all else."""
    if not any(mark in text for mark in marks):
        return encode_text(coder, text)
    cuts = regex.split("(" + "|".join(map(regex.escape, sorted(marks, key=len, reverse=True))) + ")", text)
    return [i for n, part in enumerate(cuts) for i in ([marks[part]] if n % 2 else encode_text(coder, part))]


@lru_cache(maxsize=2)
def byte_table(ranks: bytes) -> pa.LargeBinaryArray:
    """The bytes of each id, at its place. Ids that the file leaves free have none."""
    known = token_bytes(ranks)
    table: list[bytes | None] = [None] * (max(known.values(), default=-1) + 1)
    for token, rank in known.items():
        table[rank] = token
    return pa.array(table, pa.large_binary())
