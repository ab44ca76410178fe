"""Terms that stand in texts, found without holding every term against every text: both meet on each term's rarest gram.

A gram is a run of Q characters; of a shorter term it is the whole. A text that holds a term holds all of its grams, so each term waits at the one that the
fewest texts have. Only ids and hashes of grams are exploded, counted and joined; texts and terms come back for the test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.sources.tables import written

Q = 4


def grams(text: Column, q: int = Q) -> Column:
    """The distinct grams of a text; of one with fewer than q characters the whole. Null and empty texts have none."""
    n = F.char_length(text)
    runs = F.transform(F.sequence(F.lit(1), F.greatest(n - q + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(q)))
    return F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def _hashed(parts: Column) -> Column:
    return F.transform(parts, lambda x: F.xxhash64(x))


def meeting(texts: DataFrame, terms: DataFrame, q: int = Q) -> DataFrame:
    """(text_id, term_id): pairs in which the text has the term's rarest gram; what can stand in a text is among them.

    texts: text_id, text; terms: term_id, grams (an array of those that every text with the term has). Terms with a gram that no text has, or
    without any, are in no pair. Texts and terms without an id are left out.
    """
    wanted = written(terms.filter("term_id IS NOT NULL").select("term_id", F.explode(_hashed(F.col("grams"))).alias("gram"), F.array_min(F.transform("grams", F.char_length)).alias("_least")), "term-grams")
    # terms shorter than a gram are looked for by runs of their own length
    short = sorted(r[0] for r in wanted.filter(F.col("_least") < q).select("_least").distinct().collect())

    def runs(n: int) -> Column:
        return F.filter(grams(F.col("text"), n), lambda x: F.char_length(x) == n)

    parts = F.flatten(F.array(runs(q), *map(runs, short)))
    held = texts.filter("text_id IS NOT NULL").select("text_id", F.explode(F.array_distinct(_hashed(parts))).alias("gram"))
    held = written(held.join(wanted.select("gram").distinct(), "gram", "left_semi"), "text-grams")
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no text has counts as none: its term goes
    rarest = wanted.join(counts, "gram", "left").groupBy("term_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram"))).alias("r"))
    keys = written(rarest.filter("r.n > 0").select("term_id", F.col("r.gram").alias("gram")), "term-keys")
    return held.join(keys, "gram").select("text_id", "term_id")


def containments(texts: DataFrame, terms: DataFrame, q: int = Q) -> DataFrame:
    """(text_id, term_id) of all texts (text_id, text) and terms (term_id, term) where the term, not empty, stands in the text."""
    pairs = meeting(texts, terms.select("term_id", grams(F.col("term"), q).alias("grams")), q)
    return pairs.join(texts, "text_id").join(terms, "term_id").filter(F.contains("text", "term")).select("text_id", "term_id")
