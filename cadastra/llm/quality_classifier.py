"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network with calibrated probabilities.

Every token has a sparse random index vector. A token's word vector is the sum of the index vectors of its neighbours over all
documents, brought to unit length. The tokens that are most frequent over all documents, WORDS at most, have a vector of their own;
the rare rest shares TAIL vectors by hash, so that the model's size is fixed. A document is the mean and the spread of its
tokens' vectors. A network with one hidden layer, written in numpy, turns that into a logit, which a temperature fitted on rows apart
divides, so that the score is a probability.

Tokens are runs of letters, digits or other signs; capitals and a repetition of the token before are tokens of their own, since what
makes text poor is often its form.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import cut, labelled_sample
from cadastra.llm.pieces import Known, parts

WORDS, TAIL, SIZE, SPARSE, REACH, HIDDEN = 1 << 16, 1 << 14, 32, 4, 2, 24
#: Rows of the vectors that stand for no word, then the shared ones; words' own rows come after these.
CAPITALS, AGAIN, NONE, GAP, SHARED = range(5)
OWN = SHARED + TAIL
_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]+|_+")


def index_vectors(rows: int, seed: int = 1) -> np.ndarray:
    """Sparse vectors of SPARSE entries, half of them 1 and half -1; none for the gap between texts."""
    rng = np.random.default_rng(seed)
    out = np.zeros((rows, SIZE), np.int8)
    at = np.argsort(rng.random((rows, SIZE), np.float32), axis=1)[:, :SPARSE]
    np.put_along_axis(out, at, np.tile(np.array([1, -1], np.int8), SPARSE // 2)[None, :], axis=1)
    out[GAP] = 0
    return out


class Reader:
    """Texts as rows of the vectors; what was found for words between spaces is kept up to a number of bytes."""

    def __init__(self, words: dict[str, int], most: int = 48_000_000):
        self.words, self.known = words, Known(most)

    def row(self, token: str) -> int:
        found = self.words.get(token)
        return SHARED + xxhash.xxh3_64_intdigest(token.encode("utf-8", "replace")) % TAIL if found is None else found

    def rows(self, word: str) -> array:
        out = array("i")
        if word.isalpha() and word.islower():  # most words are one token
            out.append(self.row(word))
            return out
        for t in _TOKEN.findall(word):
            low = t.lower()
            out.append(self.row(low))
            if len(t) > 1 and t != low and t == t.upper():
                out.append(CAPITALS)
        return out

    def read(self, texts: list[str | None]) -> list[np.ndarray]:
        """The rows of each whole text's tokens in order; a text without tokens has one that stands for none."""
        split, out = [(t or "").split() for t in texts], []
        for w in self.known.lacking(set(chain.from_iterable(split))):
            self.known.put(w, self.rows(w).tobytes())
        for words in split:
            got = np.frombuffer(self.known.joined(words), np.int32)
            # after a token that repeats the one before, a mark
            again = np.flatnonzero(got[1:] == got[:-1]) + 2
            out.append(np.insert(got, again, AGAIN) if len(again) else got if len(got) else np.array([NONE], np.int32))
        return out


def pooled(at: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of the vectors over the tokens, and the tokens' number on a log scale."""
    kinds, n = np.unique(at, return_counts=True)
    x, share = vectors[kinds], (n / n.sum()).astype(np.float32)
    mean = share @ x
    spread = np.sqrt(np.maximum(share @ (x * x) - mean * mean, 0))
    return np.concatenate([mean, spread, [np.log1p(len(at)), len(kinds) / len(at)]]).astype(np.float32)


@dataclass
class Network:
    """Two layers over standardised inputs; score() gives probabilities of label 1."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -40, 40)))


def fit_network(x: np.ndarray, y: np.ndarray, epochs: int = 40, seed: int = 3, decay: float = 1e-4) -> Network:
    """Adam on four fifths of the rows; the temperature with the least log loss on the rest. One label only gives a constant.

    The loss is against targets drawn in from 0 and 1 by the share that one row has, as if one more had been labelled wrongly, so that rows which
    the network tells apart without an error don't lead to scores without a doubt.
    """
    rng, d = np.random.default_rng(seed), x.shape[1]
    share = min(max(float(y.mean()) if len(y) else 0.5, 1e-3), 1 - 1e-3)
    mean, scale = (x.mean(axis=0), x.std(axis=0) + 1e-3) if len(x) else (np.zeros(d), np.ones(d))
    if len(np.unique(y)) < 2:
        return Network(mean, scale, np.zeros((d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log(share / (1 - share))), 1.0)
    order = rng.permutation(len(x))
    held, rows = order[: len(x) // 5], order[len(x) // 5 :]
    z = (x - mean) / scale
    par = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(np.log(share / (1 - share)))]
    m, v, step = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par], 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(rows), max(1, len(rows) // 128)):
            h = np.tanh(z[part] @ par[0] + par[1])
            e = (1 / (1 + np.exp(-(h @ par[2] + par[3]))) - y[part]) / len(part)
            back = e[:, None] * par[2] * (1 - h * h)
            grads, step = [z[part].T @ back + decay * par[0], back.sum(axis=0), h.T @ e + decay * par[2], e.sum()], step + 1
            for k, g in enumerate(grads):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                par[k] = par[k] - 0.004 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, par[0], par[1], par[2], float(par[3]), 1.0)
    if len(held):
        s, t = net.logit(x[held]), y[held]
        soft = np.where(t > 0, 1 - 1 / (len(t) + 2), 1 / (len(t) + 2))
        loss = lambda T: (soft * np.logaddexp(0, -s / T) + (1 - soft) * np.logaddexp(0, s / T)).mean()
        net.temperature = float(min(np.geomspace(0.05, 20, 150), key=loss))
    return net


@dataclass
class Classifier:
    words: dict[str, int]
    vectors: np.ndarray
    network: Network


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, n) of what the task reads, handed on whenever there are many."""

    def rows() -> pa.RecordBatch:
        out: Counter = Counter()
        for word, n in seen.items():
            for t in _TOKEN.findall(word):
                out[t.lower()] += n
        return pa.record_batch([pa.array(out.keys(), pa.string()), pa.array(out.values(), pa.int64())], ["token", "n"])

    seen: Counter = Counter()
    for b in batches:
        for x in b.column(0):
            seen.update((x.as_py() or "").split())
            if len(seen) > 200_000:
                yield rows()
                seen.clear()
    yield rows()


def vocabulary(docs: DataFrame, most: int = WORDS) -> dict[str, int]:
    """The rows of the tokens that stand most often in the texts of all docs: all from some number of times on, `most` at most."""
    counts = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_counted, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    counts = cut(counts.withColumn("_step", F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")), "quality-tokens")
    least, held = None, 0
    # some hundreds of steps, whatever the number of tokens
    for r in sorted(counts.groupBy("_step").agg(F.count("*").alias("k")).collect(), reverse=True):
        if held + r["k"] > most:
            break
        least, held = r["_step"], held + r["k"]
    if least is None:
        return {}
    return {t: OWN + i for i, t in enumerate(sorted(counts.filter(F.col("_step") >= least).select("token").toArrow().column(0).to_pylist()))}


def _contexts(words: object):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each vector that the task has met: the sum of its neighbours' index vectors."""
        reader = Reader(words.value)
        index = index_vectors(OWN + len(reader.words))
        total, gap = np.zeros(index.shape, np.int64), np.full(REACH, GAP, np.int32)
        seen = np.zeros(len(index), bool)
        for b in batches:
            for some in parts(pc.binary_length(b.column(0)).fill_null(0).to_numpy(zero_copy_only=False)):
                texts = reader.read(b.column(0).slice(some.start, some.stop - some.start).to_pylist())
                at = np.concatenate([x for t in texts for x in (t, gap)])
                own = np.take(index, at, axis=0)
                near = np.zeros_like(own)
                for k in range(1, REACH + 1):
                    near[k:] += own[:-k]
                    near[:-k] += own[k:]
                # rows and places in one number, which sorts faster than the rows' places do
                both = (at.astype(np.int64) << 32) | np.arange(len(at))
                both.sort()
                first = np.flatnonzero(np.diff(both >> 32, prepend=-1))
                kinds = both[first] >> 32
                total[kinds] += np.add.reduceat(np.take(near, both & 0xFFFFFFFF, axis=0), first, axis=0, dtype=np.int32)
                seen[kinds] = True
        seen[GAP] = False
        rows = np.flatnonzero(seen)
        yield pa.record_batch([pa.array(rows), *[pa.array(total[rows, k]) for k in range(SIZE)]], ["row", *[f"c{k}" for k in range(SIZE)]])

    return run


def word_vectors(docs: DataFrame, words: dict[str, int]) -> np.ndarray:
    """A vector for each row, summed over the texts of all docs; the driver gets as many rows as the model has."""
    given = docs.sparkSession.sparkContext.broadcast(words)
    cols = [f"c{k}" for k in range(SIZE)]
    sums = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(_contexts(given), "row long, " + ", ".join(f"{c} long" for c in cols))
    sums = sums.groupBy("row").agg(*[F.sum(c).cast("float").alias(c) for c in cols]).toArrow()
    vectors = 0.5 * index_vectors(OWN + len(words)).astype(np.float32)  # what no neighbour has told about keeps a part of its own
    vectors[sums.column("row").to_numpy()] += np.stack([sums.column(c).to_numpy() for c in cols], axis=1)
    return vectors / (np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9)


def fit(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "quality", most: int = 8000, seed: int = 5) -> Classifier:
    """A classifier for a label of 0 and 1, fitted on up to `most` labelled documents that are not held out.

    The words and their vectors need no label and come from the texts of all docs; network and temperature see the sample alone.
    Rows without a label or a doc_id are not in the sample; a sample without rows, or with one label only, gives a constant score.
    The driver gets WORDS + TAIL rows at most and a row of fixed size for each sampled document.
    """
    spark = docs.sparkSession
    words = vocabulary(docs)
    vectors = word_vectors(docs, words)
    given = spark.sparkContext.broadcast((words, vectors))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, vectors = Reader(given.value[0]), given.value[1]
        for b in batches:
            x = [pooled(t, vectors).tolist() for t in reader.read(b.column(1).to_pylist())]
            yield pa.record_batch([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float32()))], ["doc_id", "y", "x"])

    sample = labelled_sample(docs, labels, label, most, held_out, seed)
    rows = sample.select("doc_id", "text", "y").mapInArrow(features, "doc_id long, y string, x array<float>").toArrow().sort_by("doc_id")
    x = np.array(rows.column("x").to_pylist(), float).reshape(rows.num_rows, 2 * SIZE + 2)
    return Classifier(words, vectors, fit_network(x, np.array([float(v) for v in rows.column("y").to_pylist()])))


def score(docs: DataFrame, model: Classifier, least: float = 0.3) -> DataFrame:
    """One row for each row of docs: doc_id, score (probability of label 1), predicted (1 where score >= least).

    Null and empty texts have the score of a text without tokens. Rows are scored one by one: repeated rows alike, ties don't arise; an
    empty table gives an empty result; columns besides doc_id and text are not read. Texts of any length are read whole.
    """
    given = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        reader = Reader(m.words)
        for b in batches:
            found = [np.zeros(0)]
            for some in parts(pc.binary_length(b.column(1)).fill_null(0).to_numpy(zero_copy_only=False)):
                texts = reader.read(b.column(1).slice(some.start, some.stop - some.start).to_pylist())
                found.append(m.network.score(np.stack([pooled(t, m.vectors) for t in texts])))
            yield pa.record_batch([b.column(0), pa.array(np.concatenate(found))], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", "score", (F.col("score") >= least).cast("int").alias("predicted"))
