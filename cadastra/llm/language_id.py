"""Language ID: unigram piece models over a fixed public vocabulary, with all segmentations of a word summed.

A language's model gives each piece a probability. A word's probability is the sum over all its segmentations of the product of the
pieces' probabilities, found by a forward pass over the lattice of pieces; a text's is the product over its words. Models come
from one round of expectation-maximisation per language: word counts of a bounded sample, grouped and summed in Spark, each
spread over the pieces of all its segmentations by forward and backward passes.

Words are lower-cased and start with the vocabulary's word mark; characters that no piece covers have a fixed small probability
that is the same in all languages. Beside the languages stands a model that takes all pieces to be alike: what it explains better
than every language is in none of them, and has a low score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadastra.llm.common import cut
from cadastra.llm.pieces import MARK, MODEL, Known, Vocabulary, blocks, lattice, load, parts, uncrossed

#: Words above this length are cut where no piece reaches across (which changes no sum); what is still longer is summed in logarithms.
LONG = 64
#: Each character's factor in the sums of shorter words, which keeps them within the range of doubles.
UNIT = 1e3
#: Probability of a character that is in no piece.
STRANGE = 1e-7
#: Bytes that a task takes for the words whose probabilities it keeps.
KEPT = 24_000_000
#: Documents per language that the models are fitted on, on average.
SAMPLE = 1500
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


def text_words(text: str | None, v: Vocabulary) -> list[str]:
    """The lower-cased words of a text with their marks; long ones in parts whose probabilities multiply to the word's."""
    out = []
    for w in (text or "").lower().replace(MARK, " ").split():
        out += [MARK + w] if len(w) < LONG else uncrossed(MARK + w, v.automaton)
    return out


def _logsum(terms: np.ndarray) -> np.ndarray:
    top = terms.max(axis=0)
    return top + np.log(np.exp(terms - top).sum(axis=0))


def _long_sums(lat: object, p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """ln of the sum over all segmentations up to each position of the lattice's one word; p, sizes: of its edges.

    The sums run on as products and are brought back to 1 every few positions, so that any length stays in the range of doubles.
    """
    n, reach = int(lat.lengths[0]), int(sizes.max(initial=1))
    out, logs, shift = np.ones((n + 1, p.shape[1])), np.zeros((n + 1, p.shape[1])), np.zeros(p.shape[1])
    scaled, at, done = p * UNIT ** sizes[:, None], np.searchsorted(lat.end, np.arange(n + 2)).tolist(), 0
    for e in range(1, n + 1):
        rows = slice(at[e], at[e + 1])
        out[e] = out[e - 1] * (STRANGE * UNIT) + (out[lat.start[rows]] * scaled[rows]).sum(axis=0)
        if e - done == 32 or e == n:
            logs[done + 1 : e + 1] = np.log(out[done + 1 : e + 1]) + shift
            last = out[e].copy()
            shift, done = shift + np.log(last), e
            out[max(0, e - reach) : e + 1] /= last
    return logs - np.arange(n + 1)[:, None] * np.log(UNIT)


def forward(words: list[str], p: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray | None, object]:
    """ln P of each word in each language (p: pieces x languages), with the forward sums (times UNIT for each character) and the lattice.

    A word above LONG characters stands alone in its block and has no forward sums.
    """
    lat = lattice(words, v.automaton)
    m, width = len(words), int(lat.lengths.max(initial=0))
    if width > LONG:
        alone = [lattice([w], v.automaton) for w in words]
        return np.stack([_long_sums(x, p[x.piece], v.sizes[x.piece])[-1] for x in alone]), None, lat
    scaled = p * UNIT ** v.sizes[:, None]
    alpha = np.zeros((m, width + 1, p.shape[1]))
    alpha[:, 0] = 1
    done = 0
    for end, n, rows in lat.waves():
        while done < end:
            done += 1
            alpha[:, done] += alpha[:, done - 1] * (STRANGE * UNIT)
        w = lat.word[rows]
        alpha[w, end] += alpha[w, end - n] * scaled[lat.piece[rows]]
    while done < width:
        done += 1
        alpha[:, done] += alpha[:, done - 1] * (STRANGE * UNIT)
    return np.log(alpha[np.arange(m), lat.lengths]) - lat.lengths[:, None] * np.log(UNIT), alpha, lat


def expected(words: list[str], counts: np.ndarray, p: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids and how often each is expected over all segmentations of the words, in one language (p: pieces)."""
    _, alpha, lat = forward(words, p[:, None], v)
    m, width = len(words), int(lat.lengths.max(initial=0))
    if alpha is None:
        shares = [_long_expected(w, p, v) * n for w, n in zip(words, counts, strict=True)]
        share = np.concatenate(shares)
        ids, back = np.unique(np.concatenate([lattice([w], v.automaton).piece for w in words]), return_inverse=True)
        return ids, np.bincount(back, share, len(ids))
    alpha, scaled = alpha[:, :, 0], p * UNIT**v.sizes
    beta = np.zeros((m, width + 1))
    beta[np.arange(m), lat.lengths] = 1
    # backwards: what starts at a position after all that starts later
    by_start = np.argsort(-lat.start, kind="stable")
    starts = lat.start[by_start]
    at = 0
    for pos in range(width - 1, -1, -1):
        beta[:, pos] += beta[:, pos + 1] * (STRANGE * UNIT)
        stop = at + int(np.searchsorted(-starts[at:], -pos, side="right"))
        rows = by_start[at:stop]
        np.add.at(beta[:, pos], lat.word[rows], scaled[lat.piece[rows]] * beta[lat.word[rows], lat.end[rows]])
        at = stop
    share = alpha[lat.word, lat.start] * scaled[lat.piece] * beta[lat.word, lat.end] / alpha[np.arange(m), lat.lengths][lat.word] * counts[lat.word]
    ids, back = np.unique(lat.piece, return_inverse=True)
    return ids, np.bincount(back, share, len(ids))


def _long_expected(word: str, p: np.ndarray, v: Vocabulary) -> np.ndarray:
    """How often each edge of a long word's lattice is expected, in logarithms throughout."""
    lat = lattice([word], v.automaton)
    log_p = np.log(p[lat.piece])
    alpha = _long_sums(lat, p[lat.piece, None], v.sizes[lat.piece])[:, 0]
    n = len(word)
    beta = np.zeros(n + 1)
    order = np.argsort(lat.start, kind="stable")
    at = np.searchsorted(lat.start[order], np.arange(n + 1))
    for e in range(n - 1, -1, -1):
        rows = order[at[e] : at[e + 1]]
        beta[e] = _logsum(np.append(beta[lat.end[rows]] + log_p[rows], beta[e + 1] + np.log(STRANGE)))
    return np.exp(alpha[lat.start] + log_p + beta[lat.end] - alpha[n])


@dataclass
class Models:
    languages: list[str]
    p: np.ndarray  # pieces x languages

    def with_none(self) -> np.ndarray:
        """p with a last column in which all pieces are alike."""
        return np.column_stack([self.p, np.full(len(self.p), 1 / len(self.p))])


def _sampled(docs: DataFrame, most: int, held_out, seed: int) -> DataFrame:
    """About `most` documents of each language by hash of doc_id; rows (lang, text)."""
    rows = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out)
    # a row a language comes to the driver, so that texts are filtered where they are read
    counts = rows.groupBy("lang").agg(F.count("*").alias("n")).collect()
    if not counts:
        return rows.select("lang", "text")
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], most / r["n"])]), F.col("lang"))
    at = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) / F.lit(float(1 << 53))
    return cut(rows.filter(at < share).select("lang", "text"), "language-sample")


def fit(docs: DataFrame, held_out, most: int = SAMPLE, model: str = MODEL, rounds: int = 1, seed: int = 7) -> Models:
    """Piece models of every language that documents not held out name; about `most` documents each are read for them.

    What comes to the driver is a weight for each piece and language: its size is bounded by the vocabulary. Rows with a null lang
    or text are not learned from; a language whose texts hold no word, and a table without languages, give no model.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load(model)
        for b in batches:
            langs, words = [], []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = text_words(text, v)
                langs += [lang] * len(w)
                words += w
            yield pa.record_batch([pa.array(langs, pa.string()), pa.array(words, pa.string())], ["lang", "word"])

    sample = _sampled(docs, most, held_out, seed)
    words = cut(sample.mapInArrow(counted, "lang string, word string").groupBy("lang", "word").agg(F.count("*").alias("n")), "language-words")
    v = load(model)
    names = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    # the start: all pieces alike, by the third power of their lengths in characters so that long pieces are not starved
    p = np.tile(np.array([(len(x) ** 3) * 1e-6 for x in v.pieces])[:, None], (1, max(len(names), 1)))
    for _ in range(rounds):
        given = docs.sparkSession.sparkContext.broadcast(p)

        def spread(batches: Iterator[pa.RecordBatch], given=given) -> Iterator[pa.RecordBatch]:
            v = load(model)
            for b in batches:
                langs, texts, counts = (np.array(b.column(i).to_pylist(), dtype=object) for i in range(3))
                for lang in sorted(set(langs)):
                    own = langs == lang
                    n = dict(zip(texts[own], counts[own], strict=True))
                    for block in [*blocks([w for w in n if len(w) <= LONG]), *([w] for w in n if len(w) > LONG)]:
                        ids, weight = expected(block, np.array([n[w] for w in block], float), given.value[:, names.index(lang)], v)
                        yield pa.record_batch([pa.array([lang] * len(ids), pa.string()), pa.array(ids, pa.int64()), pa.array(weight, pa.float64())], ["lang", "piece", "weight"])

        rows = words.mapInArrow(spread, "lang string, piece long, weight double").groupBy("lang", "piece").agg(F.sum("weight").alias("weight")).collect()
        total = np.full(p.shape, 0.1)
        for r in rows:
            total[r["piece"], names.index(r["lang"])] += r["weight"]
        p = total / total.sum(axis=0)
    return Models(names, p)


def identify(docs: DataFrame, models: Models, model: str = MODEL, text: str = "text", doc_id: str = "doc_id", keep: list[str] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, lang_pred, score; or the columns in keep (other names than these two) with lang_pred, score.

    score is the probability of the predicted language among the learned ones and none of them, all alike beforehand. Texts that are
    null or hold no letter, and all texts if no language was learned, are `und` with score 0; ties go to the first language by name.
    Rows are judged one by one: repeated rows alike; an empty table gives an empty result; columns besides text, doc_id and keep are
    not read. Texts of any length are scored whole, with or without spaces. keep may not name the made columns (ValueError).
    """
    if clash := {"lang_pred", "score", "_text"} & set(keep or []):
        raise ValueError(f"keep names columns that are made: {sorted(clash)}")
    given = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, m = load(model), given.value
        p = m.with_none()
        known = Known(KEPT)
        for b in batches:
            names, scores = [], []
            for rows in parts(pc.binary_length(b.column(0)).fill_null(0).to_numpy(zero_copy_only=False)):
                part = [text_words(t, v) if t and _LETTER.search(t) else None for t in b.column(0).slice(rows.start, rows.stop - rows.start).to_pylist()]
                new = known.lacking(set(chain.from_iterable(ws or () for ws in part)))
                for block in [*blocks([w for w in new if len(w) <= LONG]), *([w] for w in new if len(w) > LONG)]:
                    for w, log in zip(block, forward(block, p, v)[0].astype(np.float32), strict=True):
                        known.put(w, log.tobytes())
                for ws in part:
                    if ws is None or not m.languages:
                        names.append(UNKNOWN), scores.append(0.0)
                        continue
                    log = np.frombuffer(known.joined(ws), np.float32).reshape(-1, p.shape[1]).sum(axis=0, dtype=float)
                    k = int(log[:-1].argmax())
                    names.append(m.languages[k]), scores.append(float(np.exp(log[k] - _logsum(log))))
            yield pa.record_batch([*b.columns[first:], pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names[first:], "lang_pred", "score"])

    # the text goes to Python once and comes back if it is to be kept
    kept = [F.col(c) for c in keep if c != text] if keep else [F.col(doc_id).cast("long").alias("doc_id")]
    first = 0 if text in (keep or []) else 1
    rows = docs.select(F.col(text).cast("string").alias("_text"), *kept)
    out = rows.mapInArrow(run, T.StructType([*rows.schema.fields[first:], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    return out.select(*[F.col("_text" if c == text else c).alias(c) for c in keep or ["doc_id"]], "lang_pred", "score")
