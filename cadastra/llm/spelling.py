"""Spelling variants: words that one inserted, deleted or replaced character turns into a more frequent word.

Two words at one edit share the half that the edit isn't in: the first half, found in a dictionary sorted forwards, or the second, found in
one sorted by the words' ends. A block is a range of such a dictionary: words that agree outside a window of positions in which the
edit lies. A block of more than MOST words is divided: the edit is in the window's second half, so the shared prefix grows, or in its
first half, so the shared suffix does. With a window of one position a block holds only words at one edit, as many as there are letters.
The joins sort by block and hold its words against each other, so no join ever sees a block of more than that.

Replacements and insertions have blocks of their own. A replaced position is in one window; an insertion counts in the window with
its last possible position. So each pair is found once.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import cut, join_hot

#: Letters: maximal runs of these are words.
LETTERS = r"A-Za-zÀ-ÿ"
SHORTEST, LEAST, MOST = 5, 3, 64


def misspelt(docs: DataFrame, every: int = 97, shortest: int = SHORTEST, least: int = LEAST, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The words of all texts with their numbers of occurrences: word, n. Where `every` divides the checksum of id and word, one letter is left out.

    Words have at least `shortest` code points and `least` occurrences. Only A-Z are lower-cased. Shorter runs can't give such words and
    aren't looked at.
    """
    lower = F.translate(F.col(text).cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(F.coalesce(F.col(doc_id).cast("long").cast("string"), F.lit("")).alias("_id"), F.explode(F.regexp_extract_all(lower, F.lit(f"[{LETTERS}]{{{shortest},}}"), F.lit(0))).alias("_run"))
    runs = runs.select("_run", F.crc32(F.encode(F.concat("_id", F.lit(":"), "_run"), "UTF-8")).alias("_h"))
    at = (F.col("_h") % F.char_length("_run")).cast("int")
    short = F.concat(F.substring("_run", F.lit(1), at), F.substring("_run", at + 2, F.char_length("_run")))
    word = F.when(F.col("_h") % every == 0, short).otherwise(F.col("_run"))
    return runs.select(word.alias("word")).filter(F.char_length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least)


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows with side, word, n, len (the shorter word's), s and e (the window) to the same with their block's key.

    Sides: r for a replacement; a for the shorter, b for the longer word of an insertion, at one of its len + 1 positions.
    """
    after = F.when(F.col("side") == "a", F.col("e") - 1).otherwise(F.col("e"))
    shared = [F.substring("word", F.lit(1), F.col("s")), F.substring("word", after + 1, F.char_length("word"))]
    return rows.withColumn("key", F.xxhash64(F.when(F.col("side") == "r", "r").otherwise("i"), "len", "s", "e", *shared))


def _halved(rows: DataFrame, at: Column) -> DataFrame:
    """Each row with the window before and from a position on."""
    windows = F.array(F.struct(at.alias("s"), F.col("e").alias("e")), F.struct(F.col("s").alias("s"), at.alias("e")))
    return rows.select("side", "word", "n", "len", F.explode(windows).alias("_w")).select("side", "word", "n", "len", "_w.s", "_w.e")


def near_pairs(words: DataFrame) -> DataFrame:
    """Distinct words (word, n) to each pair of them at one edit, once: u, u_n, v, v_n."""
    size = F.char_length("word")
    sides = F.array(*[F.struct(F.lit(x).alias("side"), n.alias("len"), e.alias("e")) for x, n, e in (("r", size, size), ("a", size, size + 1), ("b", size - 1, size))])
    rows = words.select("word", "n", F.explode(sides).alias("_s")).select("_s.side", "word", "n", "_s.len", F.lit(0).alias("s"), "_s.e")
    # forwards: the first half is shared, the edit is behind it; backwards: the second half
    rows, found = _halved(rows, F.floor(F.col("len") / 2).cast("int")), []
    while True:
        rows = cut(_blocks(rows), "spelling-blocks")
        count = rows.groupBy("key").agg(F.count("*").alias("n"), F.count_if(F.col("side") != "b").alias("_left"), F.count_if(F.col("side") != "a").alias("_right"), F.max(F.col("e") - F.col("s")).alias("_wide"))
        # blocks with no two words that could be a pair go
        count = cut(count.filter("_left > 0 AND _right > 0 AND n > 1").withColumn("big", (F.col("n") > MOST) & (F.col("_wide") > 1)).select("key", "n", "big"), "spelling-counts")
        placed = cut(join_hot(rows.withColumnRenamed("n", "_n"), count, "key").withColumnRenamed("_n", "n"), "spelling-placed")
        small = placed.filter("NOT big")
        left, right = small.filter("side != 'b'").select("key", "e", F.col("word").alias("u"), F.col("n").alias("u_n")), small.filter("side != 'a'").select("key", "side", F.col("word").alias("v"), F.col("n").alias("v_n"))
        last = F.when(F.col("side") == "r", F.col("u") < F.col("v")).otherwise(F.substring("u", F.lit(1), F.col("e")) != F.substring("v", F.lit(1), F.col("e")))
        pairs = left.join(right, "key").filter(last & (F.levenshtein("u", "v", 1) == 1))
        found.append(cut(pairs.select("u", "u_n", "v", "v_n"), "spelling-pairs"))
        big = placed.filter("big")
        if big.isEmpty():
            break
        rows = _halved(big, F.floor((F.col("s") + F.col("e")) / 2).cast("int"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def roots(forms: DataFrame) -> DataFrame:
    """(word, form) to (word, root): forms are followed to the last one, twice as far in each step. Forms must not lead in a circle."""
    at = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        next_ = at.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        if at.join(next_, "root", "left_semi").isEmpty():
            return at
        at = cut(at.join(next_, "root", "left").select("word", F.coalesce("_next", "root").alias("root")), "spelling-roots")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """One row for each of the distinct words (word, n): word, n, n_near, form, form_n, root.

    Words are near at exactly one inserted, deleted or replaced code point. form is the near word with the largest n, of several the
    smallest in code-point order, if its n is at least `times` the word's (over 1, so that forms lead upwards), else null, as form_n; root is
    the last of the forms that follow each other, the word itself where it has none. A null word has no row; words of any
    length are compared whole; words without a near one have n_near 0; an empty table gives an empty result.
    """
    if times <= 1:
        raise ValueError("with a factor of 1 forms could lead in a circle")
    words = cut(words.filter(F.col("word").isNotNull()).select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    pairs = near_pairs(words)
    both = pairs.select(F.col("u").alias("word"), F.col("v").alias("_w"), F.col("v_n").alias("_n")).unionByName(pairs.select(F.col("v").alias("word"), F.col("u").alias("_w"), F.col("u_n").alias("_n")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("_n")).alias("_m"), "_w")).alias("_best"))
    rows = words.join(best.select("word", "n_near", F.col("_best._w").alias("_form"), (-F.col("_best._m")).alias("_form_n")), "word", "left")
    is_form = F.col("_form_n") >= times * F.col("n")
    rows = cut(rows.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("_form")).alias("form"), F.when(is_form, F.col("_form_n")).alias("form_n")), "spelling-forms")
    last = roots(rows.filter("form IS NOT NULL").select("word", "form"))
    return rows.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
