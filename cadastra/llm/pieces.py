"""A public piece vocabulary as an Aho-Corasick automaton, and lattices of all pieces that occur in many strings at once.

No piece holds a word mark or a line end after another character, so text may be cut before the mark of each word and around
line ends without losing a segmentation. A long word may also be cut wherever no piece reaches across, which leaves text without
spaces in short parts. Words repeat; what is found for a word is kept per task, up to a number of bytes.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np

MARK = "▁"
UNSCORED = -1e8
#: Place of the public vocabulary of SentencePiece form; a parameter of the operators.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass
class Vocabulary:
    """pieces and scores by id; automaton over the ordinary pieces, with id << 8 | length; byte ids for what no piece covers."""

    pieces: list[str]
    scores: np.ndarray
    bytes_of: list[bytes]
    byte_id: list[int]
    automaton: ahocorasick.Automaton
    longest: int
    sizes: np.ndarray


@cache
def load(model: str = MODEL) -> Vocabulary:
    """Read the vocabulary; once in each Python worker. ValueError where cutting at words would not be exact."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    automaton, byte_id, bytes_of, longest = ahocorasick.Automaton(), [-1] * 256, [b""] * n, 1
    for i, p in enumerate(pieces):
        if sp.is_byte(i):
            byte_id[int(p[3:5], 16)] = i
            bytes_of[i] = bytes([int(p[3:5], 16)])
        elif not (sp.is_control(i) or sp.is_unknown(i)):
            if MARK in p.lstrip(MARK) or "\n" in p:
                raise ValueError(f"piece {p!r} holds a word mark or a line end inside")
            automaton.add_word(p, i << 8 | len(p))
            bytes_of[i], longest = p.replace(MARK, " ").encode(), max(longest, len(p))
    automaton.make_automaton()
    scores = np.array([sp.get_score(i) for i in range(n)])
    # Runs of word marks carry a stand-in for "none" in the file; they rank below all scored pieces, above bytes.
    scores[scores < UNSCORED] = scores[scores >= UNSCORED].min() - 1
    return Vocabulary(pieces, scores, bytes_of, byte_id, automaton, longest, np.array([len(p) for p in pieces]))


#: Marks with what follows them up to the next mark; line ends stand alone.
CUTS = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


@dataclass
class Lattice:
    """All occurrences of pieces in the words: word index, start, end (in characters) and piece id, ordered by (end, length)."""

    lengths: np.ndarray
    word: np.ndarray
    start: np.ndarray
    end: np.ndarray
    piece: np.ndarray

    def waves(self) -> Iterator[tuple[int, int, slice]]:
        """(end, length, rows) in rising order of end; a word has at most one row in each."""
        key = self.end << 8 | (self.end - self.start)
        if not len(key):
            return
        at = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        for a, b in zip(at, np.append(at[1:], len(key)), strict=True):
            yield int(self.end[a]), int(self.end[a] - self.start[a]), slice(int(a), int(b))


def lattice(words: list[str], automaton: ahocorasick.Automaton) -> Lattice:
    """One pass of the automaton over the words, joined by a line end, which no piece holds; its output links give every match."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    first = np.cumsum(lengths + 1) - lengths - 1
    end, found = np.fromiter(itertools.chain.from_iterable(automaton.iter("\n".join(words))), np.int64).reshape(-1, 2).T
    piece, size = found >> 8, found & 0xFF
    word = np.searchsorted(first, end, side="right") - 1
    stop = end - first[word] + 1
    order = np.argsort(stop << 8 | size, kind="stable")
    word, stop, size, piece = word[order], stop[order], size[order], piece[order]
    return Lattice(lengths, word, stop - size, stop, piece)


def uncrossed(word: str, automaton: ahocorasick.Automaton) -> list[str]:
    """The word in parts, cut wherever no piece reaches across: each segmentation of the word is one of each part, joined."""
    cross = np.zeros(len(word) + 1, np.int32)
    for end, x in automaton.iter(word):
        cross[end + 2 - (x & 0xFF)] += 1
        cross[end + 1] -= 1
    at = [0, *(np.flatnonzero(np.cumsum(cross)[1:-1] == 0) + 1).tolist(), len(word)]
    return [word[a:b] for a, b in itertools.pairwise(at)]


class Known:
    """What was found for strings, as bytes, in two generations of up to about `most` bytes.

    When the newer is full it becomes the older, which is forgotten as a whole; what is asked for again moves to the newer.
    """

    def __init__(self, most: int):
        self.most, self.held, self.new, self.old = most, 0, {}, {}

    def put(self, word: str, value: bytes) -> None:
        self.new[word] = value
        self.held += 200 + len(word) + len(value)

    def lacking(self, words: set[str]) -> list[str]:
        """The words that have to be found out; all others are in the newer generation from now on."""
        if self.held > self.most:
            self.old, self.new, self.held = self.new, {}, 0
        out = []
        for w in words:
            if w not in self.new:
                value = self.old.get(w)
                if value is None:
                    out.append(w)
                else:
                    self.put(w, value)
        return out

    def joined(self, words: list[str]) -> bytes:
        return b"".join(map(self.new.__getitem__, words))


def parts(sizes: np.ndarray, most: int = 1_000_000) -> Iterator[slice]:
    """Rows in turn, about `most` bytes of text at a time, so that what is held doesn't grow with the batch."""
    at = 0
    for end in [*np.flatnonzero(np.diff(np.cumsum(sizes) // most, prepend=0)).tolist(), len(sizes) - 1]:
        if end >= at:
            yield slice(at, end + 1)
            at = end + 1


def blocks(words: list[str], most: int = 8192) -> Iterator[list[str]]:
    """The words from short to long in blocks whose padded length is bounded."""
    words, at = sorted(words, key=len), 0
    while at < len(words):
        n = max(1, min(most, 400_000 // (len(words[min(at + most, len(words)) - 1]) + 1)))
        yield words[at : at + n]
        at += n
