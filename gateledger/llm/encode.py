"""Whole texts to token ids with the tokenizers library, remembering pieces.

Both public word-level schemes cut a text at spaces before any merge, so equal
pieces between spaces give equal ids.  Each distinct piece is encoded once by
the library and remembered in a map of bounded size; the map stays with the
Python worker for later tasks.  Where white space is dropped, a batch of texts is
cut and its distinct pieces are found by Arrow, so only these meet the map.
"""

from __future__ import annotations

import json
import os
import sys
import types
from itertools import chain, islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

REMEMBERED = 1_000_000  # pieces; the map starts anew beyond that
RESTING = 200_000  # pieces that stay between tasks
PLAIN_BELOW = "ɐ"  # letters that every Unicode version classes alike


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in own]
    return {**{b: chr(b) for b in own}, **{b: chr(256 + i) for i, b in enumerate(others)}}


def gathered(ids: list[bytes], at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids at each place in turn, and where the ids of each place start, with their end."""
    sizes = np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
    first = np.cumsum(sizes) - sizes
    bounds = np.concatenate([[0], np.cumsum(sizes[at])])
    place = np.repeat(first[at] - bounds[:-1], sizes[at]) + np.arange(bounds[-1])
    return np.frombuffer(b"".join(ids), "<u4")[place], bounds


def cut_at(ids: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    held, ends = ids.tobytes(), (4 * bounds).tolist()
    return [held[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class _Split(Exception):
    """A piece whose end is no sure border."""


def led(piece: str) -> str:
    """A piece with the white space before it; a line end stands for itself."""
    return piece if piece[:1] == "\n" else " " + piece


class _Spaced(dict):
    """Ids of a piece and the white space before it, if it ends in none."""

    def __init__(self, owner):
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[-1].isspace():
            raise _Split
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[piece] = self.owner.chunk(led(piece))
        return ids


class _Alone(dict):
    """Ids of a piece for schemes that drop white space."""

    def __init__(self, owner):
        super().__init__()
        self.owner = owner

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[piece] = self.owner.chunk(piece)
        return ids


class PieceEncoder:
    """Ids of whole texts from the ids of pieces; a subclass supplies ``chunk``."""

    drops_space = False

    def remember(self) -> None:
        self.words: dict[str, bytes] = {}
        self.pieces = _Alone(self) if self.drops_space else _Spaced(self)

    def rest(self) -> None:
        """Forget all but the pieces met first, at the end of a task: a worker may wait long for its next.

        Frequent pieces come early, so most of what later tasks look up stays.
        """
        for known in (self.words, self.pieces):
            if len(known) > RESTING:
                first = dict(islice(known.items(), RESTING))
                known.clear()
                known.update(first)

    def chunk(self, text: str) -> bytes:
        """Ids of a text that begins and ends at sure borders."""
        raise NotImplementedError

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text of a batch."""
        return [self.encode(t) for t in texts.to_pylist()]

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if self.drops_space:
            return b"".join(map(self.pieces.__getitem__, text.replace("\n", " ").split(" ")))
        parts = text.replace("\n", " \n").split(" ")
        first, last = parts[0], parts[-1]
        try:
            if len(parts) == 1:
                return self.chunk(text)
            if first and first[-1].isspace():
                raise _Split
            ids = [self.chunk(first)]
            ids += map(self.pieces.__getitem__, parts[1:-1])
            ids.append(self.pieces[last] if last and not last[-1].isspace() else self.chunk(led(last)))
            return b"".join(ids)
        except _Split:
            return b"".join(map(self.chunk, self.bordered(text.split(" "))))

    @staticmethod
    def bordered(parts: list[str]) -> list[str]:
        """Join pieces again where white space meets white space."""
        out, held = [], parts[0]
        for part in parts[1:]:
            if held and not held[-1].isspace():
                out.append(held)
                held = " " + part
            else:
                held += " " + part
        return [*out, held]


class Encoder(PieceEncoder):
    """Ids by the tokenizers library, as little-endian unsigned 32-bit integers.

    Text that spells a special token is that token, as the library reads it, or
    with ``special`` off plain text.
    """

    def __init__(self, path: str, special: bool = True):
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = not special
        self.model = self.library.model
        self.letters = byte_letters()
        plan = json.loads(self.library.to_str())
        self.marks = [t["content"].lower() for t in plan["added_tokens"]] if special else []
        parts = (plan["pre_tokenizer"] or {}).get("pretokenizers") or [plan["pre_tokenizer"]]
        kinds = [p["type"] for p in parts if p]
        steps = [s["type"] for s in (plan["normalizer"] or {}).get("normalizers", [])]
        self.lower = "Lowercase" in steps
        self.drops_space = kinds == ["Split", "ByteLevel"] and parts[0]["behavior"] == "Removed" and parts[0]["invert"]
        if self.drops_space:
            self.pattern = regex.compile(parts[0]["pattern"]["Regex"])
        elif kinds == ["ByteLevel"] and parts[0]["use_regex"] and not parts[0]["add_prefix_space"] and not steps:
            self.pattern = regex.compile(public_tokenizers.PATTERN)
        else:
            raise ValueError(f"no known word borders in {path}")
        self.in_lines = regex.compile(r"\n|" + self.pattern.pattern)  # for patterns that drop white space
        same = os.path.commonprefix(self.marks)
        self.hint = same[:next((i for i, c in enumerate(same) if c.lower() != c.upper()), len(same))]
        self.remember()

    def encode(self, text: str) -> bytes:
        lowered = text.lower() if self.marks else ""
        if any(mark in lowered for mark in self.marks):  # a border of its own
            return self.whole(text)
        return super().encode(text)

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        if not self.drops_space:
            return super().encode_all(texts)
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        pieces = cut.flatten().dictionary_encode()
        ids, starts = gathered(
            self.remembered(pieces.dictionary.to_numpy(zero_copy_only=False).tolist()), pieces.indices.to_numpy())
        rows = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy())])
        found = cut_at(ids, starts[rows])
        if self.marks:
            # marks begin alike; only texts with that beginning can hold one
            for i in np.flatnonzero(pc.match_substring(texts, self.hint).to_numpy(zero_copy_only=False)).tolist():
                found[i] = self.encode(texts[i].as_py())
        return found

    def remembered(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces; those not seen yet go through the library together."""
        found = list(map(self.pieces.get, pieces))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            for i, ids in zip(new, self.chunks([pieces[i] for i in new]), strict=True):
                found[i] = ids
            if len(self.pieces) + len(new) > REMEMBERED:
                self.pieces.clear()
            self.pieces.update((pieces[i], found[i]) for i in new)
        return found

    def chunks(self, texts: list[str]) -> list[bytes]:
        """``chunk`` of many texts without line ends."""
        joined = "\n".join(texts)
        if max(joined, default="") >= PLAIN_BELOW:
            plain = [t for t in texts if not t or max(t) < PLAIN_BELOW]
            if len(plain) < len(texts):
                ids = iter(self.chunks(plain))
                return [next(ids) if not t or max(t) < PLAIN_BELOW else self.whole(t) for t in texts]
        found = pa.array(self.in_lines.findall(joined.lower() if self.lower else joined), pa.string()).dictionary_encode()
        words, places = found.dictionary.to_numpy(zero_copy_only=False).tolist(), found.indices.to_numpy()
        line_end = words.index("\n") if len(texts) > 1 else len(words)
        words[line_end:line_end + 1] = []
        ids = self.together(words)
        if len(texts) > 1:
            ids.insert(line_end, b"")
        ids, starts = gathered(ids, places)
        ends = np.flatnonzero(places == line_end)
        return cut_at(ids, np.concatenate([[0], starts[ends], starts[-1:]]))

    def together(self, words: list[str]) -> list[bytes]:
        """Ids of distinct words, by the library's model for those not seen yet."""
        found = list(map(self.words.get, words))
        new = [i for i, ids in enumerate(found) if ids is None]
        if new:
            # printable ASCII stands for itself
            spelled = [w if w.isascii() and w.isalpha() else w.encode().decode("latin-1").translate(self.letters)
                       for w in map(words.__getitem__, new)]
            ids = [[t.id for t in tokens] for tokens in map(self.model.tokenize, spelled)]
            bounds = np.concatenate([[0], np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))])
            for i, held in zip(new, cut_at(np.fromiter(chain.from_iterable(ids), "<u4", bounds[-1]), bounds), strict=True):
                found[i] = held
            if len(self.words) + len(new) > REMEMBERED:
                self.words.clear()
            self.words.update((words[i], found[i]) for i in new)
        return found

    def chunk(self, text: str) -> bytes:
        if not text:
            return b""
        if max(text) >= PLAIN_BELOW:  # the library's own character classes and normal form
            return self.whole(text)
        words = self.words
        if len(words) >= REMEMBERED:
            words.clear()
        out = []
        for word in self.pattern.findall(text.lower() if self.lower else text):
            ids = words.get(word)
            if ids is None:
                spelled = word.encode().decode("latin-1").translate(self.letters)
                ids = words[word] = np.array(
                    [t.id for t in self.model.tokenize(spelled)], "<u4").tobytes()
            out.append(ids)
        return b"".join(out)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _kept() -> dict[tuple, PieceEncoder]:
    """A map that outlives tasks: workers load this package anew for each, so it has a module of its own."""
    own = sys.modules.setdefault("_gateledger_encoders", types.ModuleType("_gateledger_encoders"))
    return vars(own).setdefault("kept", {})


def shared(path: str, kind: type[PieceEncoder] = Encoder, **options) -> PieceEncoder:
    """The worker's encoder of a file, kept between tasks."""
    key, kept = (kind.__name__, path, *sorted(options.items())), _kept()
    if key not in kept:
        kept[key] = kind(path, **options)
    return kept[key]
