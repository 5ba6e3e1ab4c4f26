"""Byte-level BPE encoding of many texts at once.

The tokenizers library encodes every *distinct* pre-token; numpy finds the
pre-tokens and puts their ids together. Corpora repeat their words, so this
costs a fraction of encoding each text by itself and gives the same ids. Texts
with one of the vocabulary's added tokens go to the library as they are.
"""

from __future__ import annotations

import re
from itertools import islice

import numpy as np

LETTER, NUMBER, OTHER, SPACE, BREAK, UNKNOWN = range(6)
_SAFE_CUT = re.compile(r"(?<=[A-Za-z]) (?=[A-Za-z])")


def byte_bpe_path() -> str:
    """The vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class BatchEncoder:
    """Encodes lists of texts with the byte-level BPE vocabulary at ``path``.

    Pre-tokens are those of the pattern ``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+|
    ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``. What counts as letter, number
    or white space is asked of the tokenizer itself, for each character seen.
    ``words`` bounds the pre-tokens kept from call to call, ``piece`` the
    characters worked on at a time.
    """

    def __init__(self, path: str, words: int = 500_000, piece: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.words, self.piece = words, piece
        self.kinds = np.full(0x110000, UNKNOWN, np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.slots = _Slots()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _learn(self, points: np.ndarray) -> None:
        """Asks the tokenizer for the kind of each new character."""
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for p in points.tolist():
            c = chr(p)
            if len(split("a" + c)) == 1:
                kind = LETTER
            elif len(split("1" + c)) == 1:
                kind = NUMBER
            elif len(split("!" + c)) == 1:
                kind = OTHER
            else:
                kind = SPACE
            self.kinds[p] = kind

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and where each text's ids start (one more than texts)."""
        parts, counts = [], np.zeros(len(texts), np.int64)
        held: list[str] = []
        owner: list[int] = []
        size = 0

        def flush() -> None:
            nonlocal held, owner, size
            if held:
                ids, n = self._encode(held)
                parts.append(ids)
                np.add.at(counts, owner, n)
            held, owner, size = [], [], 0

        for i, text in enumerate(texts):
            if self.added and self.added.search(text):
                flush()
                parts.append(np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32))
                counts[i] = len(parts[-1])
                continue
            for part in self._cut(text):
                if size + len(part) > self.piece:
                    flush()
                held.append(part)
                owner.append(i)
                size += len(part) + 1
        flush()
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32), np.concatenate([[0], np.cumsum(counts)])

    def _cut(self, text: str) -> list[str]:
        """Parts of a long text, cut where a pre-token is bound to start."""
        if len(text) <= self.piece:
            return [text]
        out, at = [], 0
        while len(text) - at > self.piece and (m := _SAFE_CUT.search(text, at + self.piece // 2)):
            out.append(text[at : m.start()])
            at = m.start()
        return [*out, text[at:]]

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\0".join(texts) + "\0"
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        breaks = np.cumsum([len(t) + 1 for t in texts]) - 1
        kinds = self.kinds[points]
        if (new := kinds == UNKNOWN).any():
            self._learn(np.unique(points[new]))
            kinds = self.kinds[points]
        kinds[breaks] = BREAK
        starts = self._starts(points, kinds)
        at = np.flatnonzero(starts)
        ends = np.append(at[1:], len(points))
        keep = kinds[at] != BREAK
        at, ends = at[keep], ends[keep]
        slots = self._slots([joined[b:e] for b, e in zip(at.tolist(), ends.tolist())])
        lengths = self.lengths[slots]
        total = np.concatenate([[0], np.cumsum(lengths)])
        ids = self.ids[np.repeat(self.starts[slots] - total[:-1], lengths) + np.arange(total[-1])]
        bounds = np.concatenate([[0], np.searchsorted(at, breaks)])
        return ids, np.diff(total[bounds])

    @staticmethod
    def _starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """True where a pre-token or a break starts."""
        n = len(points)
        starts = np.ones(n, bool)
        starts[1:] = kinds[1:] != kinds[:-1]
        starts |= kinds == BREAK
        runs = starts.copy()
        # the last white space before anything else stands alone, or joins it if it is a plain space
        joint = np.flatnonzero(runs[1:] & (kinds[1:] < SPACE) & (kinds[:-1] == SPACE)) + 1
        starts[joint - 1] = True
        starts[joint] = points[joint - 1] != 32
        # an apostrophe alone that starts a pre-token takes the ending of a short form
        marks = np.flatnonzero((points == 39) & runs & starts)
        marks = marks[marks + 2 < n]
        marks = marks[kinds[marks + 1] == LETTER]
        a, b = points[marks + 1], points[marks + 2]
        one = np.isin(a, [115, 116, 109, 100])
        two = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)
        for found, length in ((marks[one], 2), (marks[two], 3)):
            starts[found + 1] = False
            starts[found + length] = True
        return starts

    def _slots(self, tokens: list[str]) -> np.ndarray:
        """Where the ids of each pre-token are held; those not yet known are encoded."""
        if len(self.slots) > self.words:
            self._forget()
        held = len(self.slots)
        slots = np.fromiter(map(self.slots.__getitem__, tokens), np.int64, len(tokens))
        if new := list(islice(reversed(self.slots), len(self.slots) - held))[::-1]:
            try:
                coded = self.tokenizer.encode(new, is_pretokenized=True, add_special_tokens=False)
            except BaseException:
                self._forget()
                raise
            ids = np.array(coded.ids, np.uint32)
            lengths = np.bincount(np.array(coded.word_ids, np.int64), minlength=len(new))
            self.ids = _room(self.ids, self.used, len(ids))
            self.starts, self.lengths = _room(self.starts, held, len(new)), _room(self.lengths, held, len(new))
            self.ids[self.used : self.used + len(ids)] = ids
            self.starts[held : held + len(new)] = self.used + np.cumsum(lengths) - lengths
            self.lengths[held : held + len(new)] = lengths
            self.used += len(ids)
        return slots


class _Slots(dict[str, int]):
    """Numbers keys as they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


def _room(array: np.ndarray, used: int, more: int) -> np.ndarray:
    if used + more <= len(array):
        return array
    grown = np.zeros(max(2 * len(array), used + more), array.dtype)
    grown[:used] = array[:used]
    return grown


_ENCODERS: dict[str, BatchEncoder] = {}


def encoder(path: str) -> BatchEncoder:
    """One encoder for each vocabulary and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = BatchEncoder(path)
    return _ENCODERS[path]
