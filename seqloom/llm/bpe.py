"""Byte-level BPE with a public vocabulary.

A piece of text is merged with a priority queue of merge ranks over a doubly linked list of symbols: the queue holds one entry for each
adjacent pair that has a rank, popping the lowest joins the pair and queues the pairs it now forms with its neighbours;
entries whose symbols have changed meanwhile are stale and skipped. That is n log n in the length of the piece, so a single piece
of any length is fine. Decoding concatenates vocabulary strings.

The vocabulary is a file of ``<base64 of the token's bytes> <rank>`` lines; its path is a parameter.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache
from heapq import heapify, heappop, heappush

import regex

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
"""How text is split before merging (a fixed value of the vocabulary)."""

FULL = regex.compile(PATTERN)
ASCII = re.compile(r" ?[A-Za-z]+| ?[0-9]+|'(?:s|t|re|ve|m|ll|d)| ?[^ \t\n\r\x0b\x0cA-Za-z0-9]+|[ \t\n\r\x0b\x0c]+(?![^ \t\n\r\x0b\x0c])|[ \t\n\r\x0b\x0c]+")
"""The same on text of ASCII characters only, where it is three times as fast."""

KEPT = 400_000
"""Merged pieces a worker keeps; when there are more it starts anew. This bounds memory and changes no result."""


def default_path() -> str:
    """Place of the 50k byte-level vocabulary where the public tokenizer files are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def pieces(text: str) -> list[str]:
    """``text`` split by the pattern. Runs of ASCII-only lines take the fast pattern.

    A cut before a line feed that follows a non-space is always a border between pieces: no piece has a space after
    a non-space.
    """
    if text.isascii():
        return ASCII.findall(text)
    out: list[str] = []
    lines = text.split("\n")
    start, plain, last = 0, lines[0].isascii(), lines[0]
    for i in range(1, len(lines)):
        line = lines[i]
        if line.isascii() != plain:
            if last and not last[-1].isspace():
                block = "\n".join(lines[start:i])
                out += (ASCII if plain else FULL).findall("\n" + block if start else block)
                start, plain = i, not plain
            else:
                plain = False
        last = line
    block = "\n".join(lines[start:])
    out += (ASCII if plain else FULL).findall("\n" + block if start else block)
    return out


class Bpe:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.strings = {i: s for s, i in self.ranks.items()}
        self._kept = _Kept(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        # symbol i is piece[i:ends[i]]; symbols are linked by their starts
        ends, before = list(range(1, n + 1)), list(range(-1, n))
        get = ranks.get
        queue = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := get(piece[i : i + 2])) is not None]
        heapify(queue)
        while queue:
            _, i, j, k = heappop(queue)
            if ends[i] != j or j == n or ends[j] != k:
                continue  # stale: a symbol of the pair has been merged
            ends[i], ends[j] = k, 0
            if k < n:
                before[k] = i
                if (r := get(piece[i : ends[k]])) is not None:
                    heappush(queue, (r, i, k, ends[k]))
            if i and (r := get(piece[(h := before[i]) : k])) is not None:
                heappush(queue, (r, h, i, k))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = ends[i]
        return out

    def packed(self, text: str | None) -> bytes:
        """Ids of a text as consecutive 32-bit integers; nothing for null and empty text."""
        if not text:
            return b""
        kept = self._kept
        if len(kept) > KEPT:
            kept.clear()
        return b"".join(map(kept.__getitem__, pieces(text)))

    def encode(self, text: str | None) -> list[int]:
        return array("i", self.packed(text)).tolist()

    def decode(self, ids: list[int]) -> str:
        """The text whose ids these are."""
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", errors="replace")


class _Kept(dict):
    """Piece -> packed ids, filled as pieces are met."""

    def __init__(self, bpe: Bpe):
        super().__init__()
        self._bpe = bpe

    def __missing__(self, piece: str) -> bytes:
        packed = array("i", self._bpe.merge(piece.encode("utf-8", errors="surrogatepass"))).tobytes()
        if len(piece) <= 64:
            self[piece] = packed
        return packed


@lru_cache(4)
def load(path: str) -> Bpe:
    """The vocabulary at ``path``, loaded once in each worker process."""
    return Bpe(path)
