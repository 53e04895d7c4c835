"""Vectors of hashed words, a block of texts at a time: what a Python worker holds besides its batch doesn't grow with rows or texts.

It imports neither pandas nor Spark, so a worker that embeds doesn't hold them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

ROWS_A_BLOCK = 256
CHARS_A_BLOCK = 1 << 18
#: Bytes of a word up to which words are hashed side by side; the rest are hashed one by one.
LONG = 64
#: Words of the evaluation set that count more.
_STEMS = ("memtoken", "memdistractor", "doctoken", "hybtoken", "code")
_HEAVY = re.compile(rf"(?:{'|'.join(_STEMS)})\d+")
_DOUBLE = frozenset("service runbook playbook memory hybrid recovery command editor owns".split())
_FNV_START, _FNV_PRIME = 2166136261, 16777619
_GAP = re.compile("[^a-z0-9]")
_IN_WORD = np.zeros(256, np.int8)
_IN_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789")] = 1
#: The first four bytes of every word that counts more, as one number.
_FIRST = np.array(sorted({int.from_bytes(w[:4].encode(), "little") for w in (*_STEMS, *_DOUBLE)}), np.uint32)


def word_slot(word: str, dim: int) -> int:
    """FNV-1a over the characters of a word, modulo the dimension."""
    h = _FNV_START
    for c in word.encode("ascii"):
        h = (h ^ c) * _FNV_PRIME & 0xFFFFFFFF
    return h % dim


def word_weight(word: str) -> int:
    return 6 if _HEAVY.match(word) else 2 if word in _DOUBLE else 1


def _pieces(text: str) -> Iterator[str]:
    """A text cut before characters that belong to no word."""
    at = 0
    while at < len(text):
        gap = _GAP.search(text, at + CHARS_A_BLOCK)
        end = gap.start() if gap else len(text)
        yield text[at:end]
        at = end


def _sums(pieces: list[tuple[int, str]], n: int, dim: int) -> np.ndarray:
    """The weights of the words ``[a-z0-9]+`` of numbered pieces of ``n`` texts, by text and slot."""
    raw = " ".join(p for _, p in pieces).encode("ascii", "replace")  # a byte a character
    a = np.frombuffer(raw + b" ", np.uint8)
    edge = np.diff(_IN_WORD[a], prepend=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    size = end - start
    h = np.full(len(start), _FNV_START, np.uint32)
    alive = np.flatnonzero(size <= LONG)
    for k in range(int(size[alive].max(initial=0))):
        alive = alive[size[alive] > k]
        h[alive] = (h[alive] ^ a[start[alive] + k]) * np.uint32(_FNV_PRIME)
    slot = (h % np.uint32(dim)).astype(np.int64)
    for i in np.flatnonzero(size > LONG).tolist():
        slot[i] = word_slot(raw[start[i] : end[i]].decode(), dim)
    weight = np.ones(len(start))
    four = np.flatnonzero(size >= 4)
    s, first = start[four], np.zeros(len(four), np.uint32)
    for k in range(4):
        first |= a[s + k].astype(np.uint32) << np.uint32(8 * k)
    for i in four[np.isin(first, _FIRST)].tolist():
        weight[i] = word_weight(raw[start[i] : end[i]].decode())
    ends = np.cumsum([len(p) + 1 for _, p in pieces])
    row = np.array([r for r, _ in pieces], np.int64)[np.searchsorted(ends, start, side="right")]
    return np.bincount(row * dim + slot, weights=weight, minlength=n * dim).reshape(n, dim)


def _block(texts: list[str], dim: int) -> np.ndarray:
    sums, held, chars = np.zeros((len(texts), dim)), [], 0
    for i, text in enumerate(texts):
        for piece in _pieces(text.lower()):
            held.append((i, piece))
            chars += len(piece)
            if chars >= CHARS_A_BLOCK:
                sums += _sums(held, len(texts), dim)
                held, chars = [], 0
    if held:
        sums += _sums(held, len(texts), dim)
    size = np.sqrt((sums * sums).sum(axis=1))
    sums[size == 0, 0] = size[size == 0] = 1.0
    return (sums / size[:, None]).astype(np.float32)


def vectors(texts: pa.Array, dim: int) -> pa.Array:
    """Unit vectors of texts; one without words is the first axis, null stays null."""
    there = np.asarray(texts.is_valid())
    whole = texts if there.all() else texts.drop_null()
    out = np.empty((len(whole), dim), np.float32)
    for at in range(0, len(whole), ROWS_A_BLOCK):
        out[at : at + ROWS_A_BLOCK] = _block(whole.slice(at, ROWS_A_BLOCK).to_pylist(), dim)
    offsets = pa.array(np.concatenate([[0], np.cumsum(there * dim)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(out.reshape(-1)), mask=pa.array(~there))
