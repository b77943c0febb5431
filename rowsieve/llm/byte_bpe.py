"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text is encoded in halves, recursively down to short leaves. Two encoded neighbours are joined by encoding anew
only a window around the seam. The window grows until, on either side, it ends at a place where the tokens outside
provably stay as they are:

* A sync point of the text is a place where a match of the pattern must end, whatever stands around: between a letter
  and a non-letter, between a digit and a non-digit, between an ASCII symbol and a blank. No match spans it, so the
  encoding of a text is that of the parts before and behind it, one after the other.
* Inside one match longer than the largest window the join is of tokens: a token sequence is the encoding of its
  bytes if and only if every two neighbours are the encoding of theirs, so the window grows, token by token,
  until its ends fit the tokens next to them.

Decoding concatenates the bytes of the halves up the same tree.

The encoder is a plain Python class that runs in the Arrow workers on whole texts; there is no shuffle, one text at a
time is in memory and a lost task is simply run again.

Nulls and edge cases: null and empty texts have no tokens (hashes of the empty string); a text of any length is
encoded whole; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import functools
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession

from rowsieve.llm._common import map_texts, read_table

#: Leaves of the tree over a text, in characters (and of ids to decode, in ids), and of the tree over one long match, in bytes.
LEAF_CHARS, LEAF_BYTES = 256, 256
#: The first and the largest window beside a seam before the join goes from text to tokens.
WINDOW, MAX_WINDOW = 32, 2048

_SYNC = regex.compile(r"(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})|(?<=[!-/:-@\[-`{-~])(?=[ \t\n\r])")


class TreeEncoder:
    """Encodes as the rank file and the pattern say, without special tokens."""

    def __init__(self, path: str, pattern: str = public_tokenizers.PATTERN, leaf_chars: int = LEAF_CHARS, leaf_bytes: int = LEAF_BYTES):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.leaf_chars, self.leaf_bytes = leaf_chars, leaf_bytes
        # White space as the tokenizer's own pattern engine has it.
        self.pattern = regex.compile(pattern.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.core = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = {i: b for b, i in ranks.items()}

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text)) if text else []

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf_chars:
            return self.core.decode_bytes(ids)
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def _encode(self, text: str, lo: int, hi: int) -> list[int]:
        if hi - lo <= self.leaf_chars:
            return self.core.encode_ordinary(text[lo:hi])
        mid = (lo + hi) // 2
        left, right = self._encode(text, lo, mid), self._encode(text, mid, hi)
        return self._join(text, lo, mid, hi, left, right)

    def _join(self, text: str, lo: int, mid: int, hi: int, left: list[int], right: list[int]) -> list[int]:
        """left and right encode text[lo:mid] and text[mid:hi]; the result encodes text[lo:hi]."""
        a, b = self._before(text, lo, mid), self._behind(text, mid, hi)
        if mid - a <= MAX_WINDOW and b - mid <= MAX_WINDOW:
            kept = len(left) - len(self.core.encode_ordinary(text[a:mid]))
            skipped = len(self.core.encode_ordinary(text[mid:b]))
            return left[:kept] + self.core.encode_ordinary(text[a:b]) + right[skipped:]
        # A long run of characters of one kind: its matches one by one, long ones by tokens.
        kept, skipped = self._length(text[a:mid]), self._length(text[mid:b])
        middle = [t for m in self.pattern.findall(text[a:b]) for t in self._match(m.encode())]
        return left[: len(left) - kept] + middle + right[skipped:]

    def _length(self, text: str) -> int:
        return sum(len(self._match(m.encode())) for m in self.pattern.findall(text))

    def _before(self, text: str, lo: int, mid: int) -> int:
        """The last sync point in text[lo:mid] that leaves a character before mid, or lo."""
        window = WINDOW
        while True:
            start = max(lo, mid - window)
            points = [m.start() for m in _SYNC.finditer(text, start, mid - 1) if m.start() > start]
            if points:
                return points[-1]
            if start == lo:
                return lo
            window *= 2

    def _behind(self, text: str, mid: int, hi: int) -> int:
        """The first sync point behind mid in text[mid:hi], or hi."""
        window = WINDOW
        while True:
            end = min(hi, mid + window)
            # finditer looks at text[:end] only, so a point at its end is not seen: the next window sees it.
            found = next((m.start() for m in _SYNC.finditer(text, mid, end) if mid < m.start() < end), None)
            if found is not None:
                return found
            if end == hi:
                return hi
            window *= 2

    def _match(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf_bytes:
            return self.core._encode_single_piece(piece)
        half = len(piece) // 2
        return self._join_tokens(self._match(piece[:half]), self._match(piece[half:]))

    def _fits(self, a: int, b: int) -> bool:
        return self.core._encode_single_piece(self.token_bytes[a] + self.token_bytes[b]) == [a, b]

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.core._encode_single_piece(b"".join(self.token_bytes[t] for t in left[len(left) - i :] + right[:j]))
            before = i == len(left) or self._fits(left[-i - 1], window[0])
            behind = j == len(right) or self._fits(window[-1], right[j])
            if before and behind:
                return left[: len(left) - i] + window + right[j:]
            i, j = i * (1 if before else 2), j * (1 if behind else 2)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TreeEncoder:
    return TreeEncoder(path)


def encode_documents(docs: DataFrame, path: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",), ids: bool = True) -> DataFrame:
    """The columns in keep, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids (array<int>).

    path names the rank file, which lies in the same place on every executor; decoded_sha256 is of the bytes that
    the ids decode to."""
    path = path or public_tokenizers.path("byte_bpe_50k.tiktoken")

    def work(texts: list[str | None]) -> list[list]:
        tree = encoder(path)
        tokens = [tree.encode(x) if x else [] for x in texts]
        packed = [hashlib.sha256(np.array(x, dtype="<u4").tobytes()).hexdigest() for x in tokens]
        decoded = [hashlib.sha256(tree.decode(x)).hexdigest() for x in tokens]
        if not ids:
            return [[len(x) for x in tokens], packed, decoded]
        flat = np.fromiter((t for x in tokens for t in x), dtype=np.int32)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in tokens], dtype=np.int64)]).astype(np.int32)
        return [[len(x) for x in tokens], packed, decoded, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))]

    made = "n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids
    return map_texts(docs, text, keep, made, work)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), ids=False)
