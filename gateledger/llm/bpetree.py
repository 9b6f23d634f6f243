"""Byte-level BPE as a tree reduction, and decoding.

Encodings of two neighbouring byte strings form a monoid: to join them, only
tokens near the border can change.  A piece is halved down to short leaves; two
encodings are joined by encoding a window around the border anew, and the
window grows until the tokens outside are proven stable.  The proof is local: a
token sequence is the encoding of its bytes exactly if every two neighbours
encode to themselves when joined, which holds inside both sides and the window
already, so only the window's two edges are tested.  Decoding concatenates the
bytes of tokens level by level.

Leaves, pairs and windows recur, so their results are remembered in maps of
bounded size.

Defined results: null and empty texts have no ids; repeated rows encode alike;
no text is cut, however long a piece is.
"""

from __future__ import annotations

import base64
import hashlib
import heapq

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from gateledger.llm import encode
from gateledger.llm.common import per_text, table

LEAF = 6  # bytes
KEPT = 500_000


class TreeEncoder(encode.PieceEncoder):
    """Ids by the ranks of a file (one base64 token and its rank a line)."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in map(bytes.split, lines)}
        self.bytes_of: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.bytes_of[rank] = token
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.short: dict[bytes, list[int]] = {}
        self.stable: dict[tuple[int, int], bool] = {}
        self.remember()

    # merging

    def merged(self, data: bytes) -> list[int]:
        """Lowest rank first, leftmost first; remembered, as borders recur."""
        known = self.short.get(data)
        if known is None:
            if len(self.short) >= KEPT:
                self.short.clear()
            known = self.merge_few(data) if len(data) <= 48 else self.merge_many(data)
            if len(data) <= 48:
                self.short[data] = known
        return known

    def merge_few(self, data: bytes) -> list[int]:
        ranks = self.ranks
        parts = [data[i:i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def merge_many(self, data: bytes) -> list[int]:
        """The same for long windows, with a heap of possible merges."""
        ranks, n = self.ranks, len(data)
        end = list(range(1, n + 1))  # end of the part that starts here
        before = list(range(-1, n - 1))
        heap = []

        def offer(i):
            j = end[i]
            if j < n and (rank := ranks.get(data[i:end[j]])) is not None:
                heapq.heappush(heap, (rank, i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        alive = bytearray(b"\1" * n)
        while heap:
            _, i, j, stop = heapq.heappop(heap)
            if not alive[i] or end[i] != j or not alive[j] or end[j] != stop:
                continue
            alive[j], end[i] = 0, stop
            if stop < n:
                before[stop] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i:end[i]]])
            i = end[i]
        return out

    # joining

    def holds(self, a: int, b: int) -> bool:
        """Whether two neighbouring tokens stay as they are."""
        known = self.stable.get((a, b))
        if known is None:
            if len(self.stable) >= KEPT:
                self.stable.clear()
            known = self.stable[a, b] = self.merged(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes from their encodings."""
        if not left or not right or self.holds(left[-1], right[0]):
            return left + right
        l = r = 1  # window: tokens taken from either side
        while True:
            window = self.merged(b"".join(map(self.bytes_of.__getitem__, left[-l:] + right[:r])))
            grow_left = l < len(left) and not self.holds(left[-l - 1], window[0])
            grow_right = r < len(right) and not self.holds(window[-1], right[r])
            if not grow_left and not grow_right:
                return left[:-l] + window + right[r:]
            l = min(len(left), 2 * l) if grow_left else l
            r = min(len(right), 2 * r) if grow_right else r

    def piece(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self.piece(data[:half]), self.piece(data[half:]))

    def chunk(self, text: str) -> bytes:
        words, out = self.words, []
        if len(words) >= encode.REMEMBERED:
            words.clear()
        for word in self.pattern.findall(text):
            ids = words.get(word)
            if ids is None:
                ids = words[word] = np.array(
                    self.piece(word.encode("utf-8", "surrogatepass")), "<u4").tobytes()
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes, width: int = 1 << 16) -> bytes:
        """Bytes of ids: those of equal spans side by side, then joined upwards."""
        tokens = np.frombuffer(ids, "<u4").tolist()
        level = [b"".join(map(self.bytes_of.__getitem__, tokens[i:i + width]))
                 for i in range(0, len(tokens), width)]
        while len(level) > 1:
            level = [b"".join(level[i:i + 16]) for i in range(0, len(level), 16)]
        return level[0] if level else b""


def encode_texts(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Ids of each whole text as a binary column of unsigned 32-bit integers."""

    def make():
        encoder = encode.shared(path, TreeEncoder)
        return lambda texts: {"ids": [encoder.encode(t) for t in texts]}

    return per_text(docs, make, "ids binary", id_col, text_col)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode in one pass: counts and digests of ids and decoded bytes."""

    def make():
        encoder = encode.shared(path, TreeEncoder)

        def compute(texts):
            ids = [encoder.encode(t) for t in texts]
            return {
                "n_tokens": [len(i) // 4 for i in ids],
                "ids_sha256": [hashlib.sha256(i).hexdigest() for i in ids],
                "decoded_sha256": [hashlib.sha256(encoder.decode(i)).hexdigest() for i in ids],
            }

        return compute

    return per_text(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
