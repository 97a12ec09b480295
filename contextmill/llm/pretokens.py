"""Pre-tokens of many texts at once, by the character classes of the usual split patterns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex

from contextmill.llm.words import Powers, mix

OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
#: Endings that make one pre-token with the apostrophe before them (fixed values).
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


def character_classes() -> np.ndarray:
    """The class of every code point: letters and numbers by category, white space, the rest."""
    table = np.zeros(0x110000, np.uint8)
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for found in regex.finditer(pattern, everything):
            a, b = ord(found[0][0]), ord(found[0][-1])
            if a < 0xD800 <= b:  # a run over the gap of the surrogates
                table[a:0xD800] = table[0xE000 : b + 1] = kind
            else:
                table[a : b + 1] = kind
    return table


class Pretokens:
    """Spans of pre-tokens in the joined texts: ``starts``, ``ends``, ``first`` of each text."""

    def __init__(self, texts: list[str], classes: np.ndarray, spaced: bool):
        """``spaced``: one space goes with the word behind it, other white space stays, numbers are
        runs. Otherwise white space is dropped and each number is alone."""
        self.joined = "\n".join(texts) + "\n"
        self.codes = np.frombuffer(self.joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.concatenate(([0], np.cumsum(lengths + 1)))
        kind = classes[self.codes]
        kind[self.begin[1:] - 1] = EDGE
        # Runs of one class, but every edge and, unless spaced, every number is a run of its own.
        fresh = np.diff(kind, prepend=255) != 0
        fresh |= kind == EDGE
        if not spaced:
            fresh |= kind == NUMBER
        at = np.flatnonzero(fresh)
        to = np.append(at[1:], len(kind))
        kind = kind[at]
        starts, ends = at.copy(), to.copy()
        keep = kind < SPACE
        extra: list[np.ndarray] = []
        if spaced:
            blank = kind == SPACE
            before_word = blank & np.append(keep[1:], False)
            single = before_word & (self.codes[to - 1] == 32)
            starts[1:] -= single[:-1]  # the space goes to the next run
            ends[before_word] -= 1
            keep = keep | (blank & (ends > starts))
            lone = to[before_word & ~single] - 1
            extra = [np.stack((lone, lone + 1))]
        # An apostrophe alone, first in its pre-token, takes an ending from the letters behind it.
        quote = np.flatnonzero((to - at == 1) & (self.codes[at] == 39) & (starts == at))
        quote = quote[quote + 1 < len(at)]
        quote = quote[kind[quote + 1] == LETTER]
        if len(quote):
            left = to[quote + 1] - at[quote + 1]
            taken = np.zeros(len(quote), np.int64)
            for ending in ENDINGS:
                same = left >= len(ending)
                for i, c in enumerate(ending):
                    same &= self.codes[np.minimum(at[quote + 1] + i, len(self.codes) - 1)] == ord(c)
                taken[same] = len(ending)
            ends[quote] += taken
            starts[quote + 1] += taken
            keep[quote + 1] &= taken < left
        spans = np.concatenate([np.stack((starts[keep], ends[keep])), *extra], axis=1)
        if extra and extra[0].size:
            spans = spans[:, np.argsort(spans[0], kind="stable")]
        self.starts, self.ends = spans
        self.first = np.searchsorted(self.starts, self.begin)

    def __len__(self) -> int:
        return len(self.starts)

    def word(self, i: int) -> str:
        return self.joined[self.starts[i] : self.ends[i]]

    def strings(self, at: np.ndarray) -> pa.Array:
        """Those pre-tokens as an Arrow array."""
        width = 1 + (self.codes > 0x7F) + (self.codes > 0x7FF) + (self.codes > 0xFFFF)
        begin = np.concatenate(([0], np.cumsum(width)))
        starts, lengths = begin[self.starts[at]], begin[self.ends[at]] - begin[self.starts[at]]
        flat = gather(np.frombuffer(self.joined.encode(), np.uint8), starts, lengths)
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        return pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(flat))

    def hash(self, powers: Powers, turn: int = 0) -> np.ndarray:
        """A 64-bit hash of each pre-token."""
        value = mix(self.codes + np.uint64(1))
        up, down = powers.to(len(value) + 1)
        if turn:
            value = (value << np.uint64(turn)) | (value >> np.uint64(64 - turn))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * up[: len(value)], dtype=np.uint64)))
        return mix((sums[self.ends] - sums[self.starts]) * down[self.starts] + (self.ends - self.starts).astype(np.uint64))

    def hashes(self, one: Powers, two: Powers) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes."""
        return self.hash(one), self.hash(two, 21)


def hash_bases() -> tuple[Powers, Powers]:
    return Powers(0x9E3779B97F4A7C15), Powers(0xC2B2AE3D27D4EB4F)


def gather(flat: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``flat[begin[i] : begin[i] + lengths[i]]`` of all i, one after the other."""
    total = int(lengths.sum())
    offset = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    return flat[np.repeat(begin - offset, lengths) + np.arange(total)]
