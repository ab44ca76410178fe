"""Quality rules: gradient-boosted trees over document statistics.

Trees are grown on histograms of a bounded sample of labelled documents, with monotonic constraints: more symbols, repeated lines,
repeated words, capitals or exclamation marks never raise a score. The fitted trees are complete and flattened into three numpy arrays
(feature and threshold of each inner node, value of each leaf), which score a batch of documents level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import SPACES, WordHashes, crc_rest, labelled_sample

SYMBOLS = "#*$%&|<>"
WINDOW = 5
#: Each feature with its constraint: -1 never raises the score, 0 is free.
FEATURES = {"log_words": 0, "word_chars": 0, "symbols": -1, "dup_lines": -1, "repeat_words": -1, "capitals": -1, "exclamations": -1, "line_words": 0}
_MUL = np.uint64(0x9E3779B97F4A7C15)
_UPPER = bytes(range(65, 91))


def repeat_words(h: np.ndarray, window: int = WINDOW) -> int:
    """How many words stand in windows of `window` words that the text has twice or more; h: hashes of the words."""
    n = len(h) - window + 1
    if n < 2:
        return 0
    s = np.zeros(n, np.uint64)
    for k in range(window):
        s = (s ^ (s >> np.uint64(29))) * _MUL + h[k : k + n]
    order = np.argsort(s, kind="stable")
    same = s[order[1:]] == s[order[:-1]]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    at = np.flatnonzero(again)
    np.add.at(cover, at, 1)
    np.add.at(cover, at + window, -1)
    return int((np.cumsum(cover[:-1]) > 0).sum())


def statistics(text: str | None, known: dict) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text, and its features."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, SPACES))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    dup = len(lines) - len(set(lines))
    repeat = repeat_words(np.fromiter(map(known.__getitem__, words), np.uint64, n))
    w, c = max(n, 1), max(chars, 1)
    capitals = (len(raw) - len(raw.translate(None, _UPPER))) / c
    return (n, chars, symbols, dup, repeat), [float(np.log1p(n)), chars / w, symbols / w, dup / max(len(lines), 1), repeat / w, capitals, text.count("!") / w, n / max(len(lines), 1)]


@dataclass
class Trees:
    """Complete trees of one depth: inner nodes and leaves as in a heap; left where the feature is <= the threshold."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1 for the rows of x."""
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.leaf, strict=True):
            at = np.zeros(len(x), np.int64)
            while len(at) and at[0] < inner:
                at = 2 * at + 1 + (x[rows, f[at]] > t[at])
            out += v[at - inner] if len(at) else 0
        return 1 / (1 + np.exp(-out))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 5.0) -> Trees:
    """Boosted trees for logistic loss. Without rows, or with one label only, the score is constant."""
    mean = min(max(float(y.mean()) if len(y) else 1.0, 1e-3), 1 - 1e-3)
    base, inner = float(np.log(mean / (1 - mean))), 2**depth - 1
    none = Trees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, inner + 1)))
    if len(np.unique(y)) < 2:
        return none
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    binned = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T, strict=True)], axis=1)
    out, features, thresholds, leaves = np.full(len(x), base), [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-out))
        g, h = y - p, p * (1 - p)
        feature, threshold, value = np.zeros(inner, np.int64), np.full(inner, np.inf), np.zeros(2 * inner + 1)
        low, high, node = np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf), np.zeros(len(x), np.int64)
        for k in range(inner):
            rows = np.flatnonzero(node == k)
            best, gs, hs = (1e-6, None), g[rows].sum(), h[rows].sum()
            for j, e in enumerate(edges):
                if not len(e) or len(rows) < 20:
                    continue
                at = binned[rows, j]
                gl, hl = (np.cumsum(np.bincount(at, z[rows], len(e) + 1))[:-1] for z in (g, h))
                vl, vr = np.clip(gl / (hl + ridge), low[k], high[k]), np.clip((gs - gl) / (hs - hl + ridge), low[k], high[k])
                gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                gain[(signs[j] * (vr - vl) < 0) | (hl < 1) | (hs - hl < 1)] = -1
                if gain.max() > best[0]:
                    best = (gain.max(), (j, int(gain.argmax()), vl[gain.argmax()], vr[gain.argmax()]))
            l, r = 2 * k + 1, 2 * k + 2
            low[[l, r]], high[[l, r]], value[[l, r]] = low[k], high[k], value[k]
            if k == 0 and best[1] is None:
                return none if not features else Trees(base, np.array(features), np.array(thresholds), np.array(leaves))
            if best[1]:
                j, cutoff, a, b = best[1]
                feature[k], threshold[k], value[l], value[r] = j, edges[j][cutoff], a, b
                if signs[j]:  # what lies below on either side stays on its side of the middle
                    mid = (a + b) / 2
                    (high if signs[j] > 0 else low)[l] = mid
                    (low if signs[j] > 0 else high)[r] = mid
                node[rows] = np.where(binned[rows, j] <= cutoff, l, r)
            else:
                node[rows] = l
        step = rate * value[inner:]
        out += step[node - inner]
        features.append(feature), thresholds.append(threshold), leaves.append(step)
    return Trees(base, np.array(features), np.array(thresholds), np.array(leaves))


_KINDS = {"n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64()}


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = WordHashes()
    for b in batches:
        x = [statistics(t.as_py(), known)[1] for t in b.column(0)]
        yield pa.record_batch([b.column(1), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 8000, seed: int = 9) -> Trees:
    """Trees for a label of 0 and 1, fitted on up to `most` labelled documents with crc32(doc_id) mod 5 other than 0."""
    sample = labelled_sample(docs, labels, label, most, crc_rest(F.col("doc_id"), 5) == 0, seed)
    rows = sample.orderBy("doc_id").select("text", "y").mapInArrow(_measured, "y string, x array<double>").collect()
    x = np.array([r["x"] for r in rows], float).reshape(len(rows), len(FEATURES))
    return fit_trees(x, np.array([float(r["y"]) for r in rows]), list(FEATURES.values()))


def judge(docs: DataFrame, trees: Trees, least: float = 0.3) -> DataFrame:
    """One row for each row of docs: doc_id, the five statistics, base_failed, score, kept.

    base_failed: fewer than 10 words, or more than 20 words in 100 stand in repeated windows. kept is false where base_failed is
    true, else whether the trees' score is at least `least` (a tie with it is kept). Texts of any length are read whole. Null text has no words and fails. Rows are judged
    one by one: repeated rows alike; an empty table gives an empty result; columns besides doc_id and text are not read.
    """
    given = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for b in batches:
            got = [statistics(t.as_py(), known) for t in b.column(1)]
            score = given.value.score(np.array([x for _, x in got], float).reshape(len(got), len(FEATURES)))
            cols = [pa.array([s[i] for s, _ in got], k) for i, k in enumerate(_KINDS.values())]
            yield pa.record_batch([b.column(0), *cols, pa.array(score)], ["doc_id", *_KINDS, "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{k} long" for k in _KINDS) + ", score double")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.select("doc_id", *_KINDS, failed.alias("base_failed"), "score", (~failed & (F.col("score") >= least)).alias("kept"))
