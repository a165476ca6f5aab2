"""Exact token counts of whole texts under a public byte-level BPE vocabulary, a column at a time.

A byte-level BPE first cuts a text into pieces (a word with the blank before it, a number, a run of signs, white space)
and then encodes every piece by itself, so the count of a text is the sum over its pieces. The cut is computed here for a
whole Arrow batch at once from the characters' classes, distinct pieces are found by dictionary encoding, and only those
that this worker hasn't met yet reach the encoder. The counts equal ``encode_ordinary`` of the library, text by text.

Defined results: null and '' have 0 tokens; a text of any length is counted whole (long ones in windows cut where the
pieces can't be affected); special tokens' strings are ordinary text.
"""

from __future__ import annotations

import base64
import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The vocabulary's place is a parameter everywhere; the file must be present on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How this vocabulary's published pre-tokenizer cuts texts, and the contractions it cuts off.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHORT, LONG = "stmd", ("re", "ve", "ll")
#: Characters handled at a time, and remembered pieces per worker: bounds of memory, without influence on the result.
WINDOW, REMEMBERED = 1 << 22, 1 << 20

_BLANK, _LETTER, _NUMBER, _SIGN = range(4)


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _SIGN) for c in range(0x110000)), np.uint8, 0x110000)
    blanks = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    table[blanks] = _BLANK
    return table


@functools.cache
def encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.cache
def _remembered(path: str) -> dict[str, int]:
    return {}


def _starts(cp: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which characters begin a piece; ``first`` marks those that begin a text."""
    kind = _classes()[cp]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # The last blank before a text goes on is cut off its run; a space then joins what follows.
    goes_on = np.zeros(len(cp), bool)
    goes_on[:-1] = (kind[:-1] == _BLANK) & (kind[1:] != _BLANK) & ~first[1:]
    start |= goes_on
    start[np.flatnonzero(goes_on & (cp == 32)) + 1] = False
    mark = np.flatnonzero((cp[:-2] == 39) & start[:-2] & ~first[1:-1]) if len(cp) > 2 else np.empty(0, np.int64)
    after, then = cp[mark + 1], np.where(first[mark + 2], 0, cp[mark + 2]) if len(mark) else mark
    size = np.isin(after, [ord(c) for c in SHORT]).astype(np.int64) * 2
    for a, b in LONG:
        size[(after == ord(a)) & (then == ord(b))] = 3
    if len(cp) >= 2 and cp[-2] == 39 and start[-2] and not first[-1] and chr(cp[-1]) in SHORT:
        start[-1] = False
    mark, size = mark[size > 0], size[size > 0]
    start[mark + 1] = False
    end = mark + size
    start[end[end < len(cp)]] = True
    return start


def _count(texts: list[str], path: str) -> np.ndarray:
    whole = "".join(texts)
    ends = np.cumsum([0, *map(len, texts)])
    if not whole:
        return np.zeros(len(texts), np.int64)
    cp = np.frombuffer(whole.encode("utf-32-le"), "<u4")
    first = np.zeros(len(cp), bool)
    first[ends[:-1][ends[:-1] < len(cp)]] = True
    at = np.flatnonzero(_starts(cp, first))
    width = 1 + (cp >= 0x80).astype(np.int8) + (cp >= 0x800) + (cp >= 0x10000)
    byte = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])
    offsets = np.append(byte[at], byte[-1]).astype(np.int32)
    pieces = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(whole.encode())).dictionary_encode()
    known, encode = _remembered(path), encoding(path).encode_ordinary
    if len(known) > REMEMBERED:
        known.clear()
    cost = np.empty(len(pieces.dictionary), np.int64)
    for i, p in enumerate(pieces.dictionary.to_pylist()):
        n = known.get(p)
        if n is None:
            n = known[p] = len(encode(p))
        cost[i] = n
    total = np.concatenate([[0], np.cumsum(cost[pieces.indices.to_numpy()])])
    of = np.searchsorted(at, ends)
    return total[of[1:]] - total[of[:-1]]


def _windows(text: str) -> list[str]:
    """text in parts of about WINDOW characters, each but the last ending in a line end between two visible ones: there a
    piece of one character ends, whatever surrounds it. Text without such a place stays whole."""
    parts, at = [], 0
    while len(text) - at > WINDOW:
        cut = at + WINDOW
        while (cut := text.find("\n", cut)) >= 0 and cut + 1 < len(text) and (text[cut - 1].isspace() or text[cut + 1].isspace()):
            cut += 1
        if cut < 0 or cut + 1 >= len(text):
            break
        parts.append(text[at : cut + 1])
        at = cut + 1
    return [*parts, text[at:]]


def count(texts: list[str | None], path: str = VOCABULARY) -> np.ndarray:
    """Tokens of each text."""
    out, group, held, size = np.zeros(len(texts), np.int64), [], [], 0

    def flush() -> None:
        nonlocal size
        np.add.at(out, held, _count(group, path))
        group.clear(), held.clear()
        size = 0

    for i, text in enumerate(texts):
        for part in _windows(text or ""):
            group.append(part), held.append(i)
            size += len(part)
            if size >= WINDOW:
                flush()
    if group:
        flush()
    return out


def token_count(text: Column | str, path: str = VOCABULARY) -> Column:
    """A bigint column: tokens of ``text`` under the vocabulary at ``path``."""

    @F.arrow_udf("bigint")
    def tokens(a: pa.Array) -> pa.Array:
        return pa.array(count(a.to_pylist(), path))

    return tokens(text)
