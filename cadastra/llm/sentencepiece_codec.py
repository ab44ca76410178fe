"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the vocabulary's pieces passes once over the text; at each position its output links give
the pieces that end there, and each relaxes the best score of its end. The best path is the encoding: the segmentation with
the largest sum of piece scores. Characters that no piece covers are encoded as their bytes. Decoding joins the pieces'
bytes, so that decode(encode(text)) is the text, whatever it holds.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastra.llm.pieces import CUTS, MARK, MODEL, Known, Vocabulary, blocks, lattice, load, parts, uncrossed


#: The score of a character in bytes: so low that it is a last resort.
BYTES = -1e7
#: Segments above this length are cut where no piece reaches across; what is still longer is searched by itself.
LONG = 256


def _ids(word: str, path: np.ndarray, v: Vocabulary) -> np.ndarray:
    """The path with the bytes of the characters that stand for themselves (-1)."""
    ids, i = [], 0
    for x in path.tolist():
        ids += [x] if x >= 0 else [v.byte_id[b] for b in word[i].encode("utf-8", "replace")]
        i += len(v.pieces[x]) if x >= 0 else 1
    return np.array(ids, np.int32)


def best_path(word: str, v: Vocabulary) -> np.ndarray:
    """The piece ids of one long word: the same search as best_paths, position by position."""
    n, done = len(word), 0
    best, step, piece = array("d", [0.0]) + array("d", [-math.inf]) * n, array("i", [0]) * (n + 1), array("i", [-1]) * (n + 1)
    scores = v.scores.tolist()
    for last, x in chain(v.automaton.iter(word), [(n - 1, 0)]):
        end, i, size = last + 1, x >> 8, x & 0xFF
        while done < end:
            done += 1
            best[done], step[done] = best[done - 1] + BYTES, 1
        if not size:
            continue
        s = best[end - size] + scores[i]
        if s > best[end] or (s == best[end] and piece[end] >= 0 and size < step[end]):
            best[end], step[end], piece[end] = s, size, i
    path, at = [], n
    while at:
        path.append(piece[at])
        at -= step[at]
    return _ids(word, np.array(path[::-1], np.int32), v)


def best_paths(words: list[str], v: Vocabulary) -> list[np.ndarray]:
    """The piece ids of each word on its best path; a word is free of line ends unless it is one.

    Of paths with equal sums the one whose last piece is the shortest is taken, then the one before it, and so on.
    """
    lat = lattice(words, v.automaton)
    m, width = len(words), int(lat.lengths.max()) if len(words) else 0
    best = np.full((m, width + 1), -np.inf)
    best[:, 0] = 0
    step = np.zeros((m, width + 1), np.int32)
    piece = np.full((m, width + 1), -1, np.int32)
    waves, done = lat.waves(), 0

    def uncovered(upto: int) -> None:
        """A single character may always stand for its bytes."""
        nonlocal done
        while done < upto:
            done += 1
            best[:, done], step[:, done] = best[:, done - 1] + BYTES, 1

    for end, n, rows in waves:
        uncovered(end)
        w, i = lat.word[rows], lat.piece[rows]
        score = best[w, end - n] + v.scores[i]
        better = score > best[w, end]
        w = w[better]
        best[w, end], step[w, end], piece[w, end] = score[better], n, i[better]
    uncovered(width)
    # all words are walked back from their ends at once, a piece in each step
    rows, at, columns = np.arange(m), lat.lengths.copy(), []
    while at.any():
        columns.append(np.where(at > 0, piece[rows, at], -2))
        at -= np.where(at > 0, step[rows, at], 0)
    table = np.stack(columns[::-1], axis=1).astype(np.int32) if columns else np.zeros((m, 0), np.int32)
    sizes, spelled = (table != -2).sum(axis=1).tolist(), set(np.flatnonzero((table == -1).any(axis=1)).tolist())
    out = [x[len(x) - n :] for x, n in zip(table, sizes, strict=True)]
    for k in spelled:
        out[k] = _ids(words[k], out[k], v)
    return out


class Encoder:
    """Piece ids (as bytes of int32) of text segments; what was found is kept up to a number of bytes."""

    def __init__(self, v: Vocabulary, most: int = 24_000_000):
        self.v, self.known = v, Known(most)

    def learn(self, segments: set[str]) -> None:
        new = self.known.lacking(segments)
        for block in blocks([s for s in new if len(s) <= LONG]):
            for s, ids in zip(block, best_paths(block, self.v), strict=True):
                self.known.put(s, ids.tobytes())
        for s in new:
            if len(s) > LONG:
                split = uncrossed(s, self.v.automaton)
                found = {x: ids for block in blocks(list({x for x in split if len(x) <= LONG})) for x, ids in zip(block, best_paths(block, self.v), strict=True)}
                self.known.put(s, b"".join((found[x] if x in found else best_path(x, self.v)).tobytes() for x in split))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts. A word mark that stands in a text is spelled in bytes, so that decoding tells it from a space."""
        spelled = np.array([self.v.byte_id[b] for b in MARK.encode()], np.int32).tobytes()
        cut = [[CUTS.findall(x.replace(" ", MARK)) for x in (" " + t).split(MARK)] if MARK in t else [CUTS.findall(MARK + t.replace(" ", MARK))] if t else [] for t in texts]
        self.learn(set(chain.from_iterable(chain.from_iterable(cut))))
        return [np.frombuffer(spelled.join(map(self.known.joined, p)), np.int32) for p in cut]


@cache
def encoder(model: str) -> Encoder:
    """One for all tasks of a Python worker."""
    return Encoder(load(model))


def decode(ids: list[int], v: Vocabulary) -> str:
    """The text of piece ids; the space that encoding puts first is taken off."""
    return b"".join(map(v.bytes_of.__getitem__, ids)).decode("utf-8", "replace")[1:]


def encode_documents(docs: DataFrame, model: str = MODEL, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, or the columns in keep, with n_pieces, ids, round_trip (whether decoding the ids gives the text).

    Null and empty texts have no pieces and pass the round trip. Rows are encoded one by one: repeated rows alike; an empty
    table gives an empty result; columns besides text, doc_id and keep are not read. keep may not name the three made columns
    (ValueError). Texts of any length are encoded whole, with or without spaces.
    """
    if clash := {"n_pieces", "ids", "round_trip", "_text"} & set(keep or []):
        raise ValueError(f"keep names columns that are made: {sorted(clash)}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        known = encoder(model)
        for b in batches:
            for rows in parts(pc.binary_length(b.column(0)).fill_null(0).to_numpy(zero_copy_only=False)):
                part = b.slice(rows.start, rows.stop - rows.start)
                texts = [x or "" for x in part.column(0).to_pylist()]
                ids = known.encode(texts)
                same = [decode(i.tolist(), v) == t for i, t in zip(ids, texts, strict=True)]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))
                yield pa.record_batch([*part.columns[first:], pa.array([len(i) for i in ids], pa.int64()), lists, pa.array(same, pa.bool_())], [*part.schema.names[first:], "n_pieces", "ids", "round_trip"])

    # the text goes to Python once and comes back if it is to be kept
    kept = [F.col(c) for c in keep if c != text] if keep else [F.col(doc_id).cast("long").alias("doc_id")]
    first = 0 if text in (keep or []) else 1
    rows = docs.select(F.col(text).cast("string").alias("_text"), *kept)
    made = T.StructType.fromDDL("n_pieces long, ids array<int>, round_trip boolean")
    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields[first:], *made.fields]))
    return out.select(*[F.col("_text" if c == text else c).alias(c) for c in keep or ["doc_id"]], *made.names)


def decode_documents(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and text of encoded rows (doc_id, ids); null ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array([decode(x or [], v) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
