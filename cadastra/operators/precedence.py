"""Which candidates override which, in the order in which a search has ranked them, for groups of any size.

The rule compares each candidate with those behind it: of two of different documents and levels with one type and like subjects the one of the
higher level goes out. One that is out when its turn comes compares no more. So whether a candidate gets its turn depends on candidates of lower
levels before it only, and levels settle one after the other: there are as many rounds as levels, whatever the number of candidates.

No pair of candidates is made. A subject's candidates are summed up by level: for two documents the first place of one that gets its turn, and
the last place at which one is still in. Candidates look these up for the subjects like their own, which are found once for all distinct subjects.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.text import subject_normalise
from cadastra.operators.containment import containments
from cadastra.sources.tables import written


def like_subjects(subjects: DataFrame, least: int = 6) -> DataFrame:
    """(subject, other) of distinct subjects (subject): each with itself, and where both have `least` characters and one holds the other, both ways."""
    ids = written(subjects.select("subject", F.xxhash64("subject").alias("k")), "subjects")
    long = ids.filter(F.char_length("subject") >= least)
    held = containments(long.select(F.col("k").alias("text_id"), F.col("subject").alias("text")), long.select(F.col("k").alias("term_id"), F.col("subject").alias("term"))).filter("text_id <> term_id")
    name = lambda c: ids.select(F.col("k").alias(c), F.col("subject").alias(f"{c}_name"))
    named = held.join(name("text_id"), "text_id").join(name("term_id"), "term_id")
    a, b = F.col("text_id_name"), F.col("term_id_name")
    return ids.select("subject", F.col("subject").alias("other")).unionByName(named.select(a.alias("subject"), b.alias("other"))).unionByName(named.select(b.alias("subject"), a.alias("other")))


def _two(rows: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """For each key and the two documents that come first by the order: keys, document_id, best (the order's struct)."""
    per = rows.groupBy(*keys, "document_id").agg(F.min(order).alias("best"))
    return per.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("best"))).filter("_r <= 2").drop("_r")


def precedence(rows: DataFrame) -> DataFrame:
    """rows (query_id, pos, id, document_id, level, type, subject) with kept and winner_id: for each that goes out one that puts it out.

    pos is a candidate's place within its query, no two alike. Subjects are like where they are equal after normalising or, both with six characters
    or more, one holds the other; an empty subject is like none. winner_id: of candidates before it the first one; else of those behind it one that
    stays in longest. Rows without a document, level or type override nothing and stay.
    """
    keys = ["query_id", "type", "_subject"]
    every = written(rows.withColumn("_subject", subject_normalise(F.col("subject"))), "candidates")
    able = written(every.filter("_subject <> '' AND document_id IS NOT NULL AND level IS NOT NULL AND type IS NOT NULL").select("query_id", "pos", "id", "document_id", "level", "type", "_subject"), "candidates-able")
    like = written(like_subjects(able.select(F.col("_subject").alias("subject")).distinct()), "subjects-like").withColumnsRenamed({"subject": "_subject", "other": "_other"})
    levels = sorted(r[0] for r in able.select("level").distinct().collect())
    # what of each subject counts for others, level by level: its first candidates that get their turn
    first, settled = None, []
    for level in levels:
        own = able.filter(F.col("level") == level)
        if first is not None:
            # subjects of this level with all that lower levels say about subjects like them: two documents a level
            asked = own.select(*keys).distinct().join(like, "_subject")
            said = asked.join(first.withColumnRenamed("_subject", "_other"), ["query_id", "type", "_other"])
            said = _two(said.select(*keys, "document_id", "best"), keys, F.col("best"))
            said = said.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("best", "document_id"))).alias("_said"))
            own = own.join(said, keys, "left")
            # the first of another document; it has to stand before
            against = F.try_element_at(F.filter("_said", lambda x: x["document_id"] != F.col("document_id")), F.lit(1))["best"]
            own = own.withColumn("_by", F.when(against["pos"] < F.col("pos"), against)).drop("_said")
        else:
            own = own.withColumn("_by", F.lit(None).cast(f"struct<pos:{dict(able.dtypes)['pos']},id:{dict(able.dtypes)['id']}>"))
        own = written(own, "candidates-settled")
        settled.append(own)
        new = _two(own.filter("_by IS NULL"), [*keys, "level"], F.struct("pos", "id"))
        first = written(new if first is None else first.unionByName(new), "precedence-first")
    if not settled:
        return every.drop("_subject").withColumn("kept", F.lit(True)).withColumn("winner_id", F.lit(None).cast(dict(rows.dtypes)["id"]))
    told = written(reduce(DataFrame.unionByName, settled), "candidates-told")
    # how long each stays in: up to its own place, or to that of the one that puts it out
    stay = told.withColumn("_end", F.coalesce(F.col("_by.pos"), F.col("pos")))
    last = _two(stay, [*keys, "level"], F.struct((-F.col("_end")).alias("end"), F.col("id")))
    # those that got their turn look for one of a lower level that is still in behind them
    asked = told.filter("_by IS NULL").select(*keys, "level").distinct().join(like, "_subject")
    said = asked.join(last.select("query_id", "type", F.col("_subject").alias("_other"), F.col("level").alias("_lower"), "document_id", "best"), ["query_id", "type", "_other"]).filter(F.col("_lower") < F.col("level"))
    said = _two(said.select(*keys, "level", "document_id", "best"), [*keys, "level"], F.col("best"))
    said = said.groupBy(*keys, "level").agg(F.array_sort(F.collect_list(F.struct("best", "document_id"))).alias("_said"))
    behind = told.filter("_by IS NULL").join(said, [*keys, "level"])
    against = F.try_element_at(F.filter("_said", lambda x: x["document_id"] != F.col("document_id")), F.lit(1))["best"]
    out = behind.select("query_id", "pos", against.alias("b")).filter(-F.col("b.end") > F.col("pos")).select("query_id", "pos", F.col("b.id").alias("winner_id"))
    out = out.unionByName(told.filter("_by IS NOT NULL").select("query_id", "pos", F.col("_by.id").alias("winner_id")))
    full = every.drop("_subject").join(out, ["query_id", "pos"], "left")
    return full.select(*rows.columns, F.col("winner_id").isNull().alias("kept"), "winner_id")


def decisions(judged: DataFrame) -> DataFrame:
    """(query_id, winner_id, loser_id) and subject, document_id and level of both (winner_..., loser_...) for what precedence() has put out."""
    side = lambda p, *more: judged.select("query_id", F.col("id").alias(f"{p}_id"), *[F.col(c).alias(f"{p}_{n}") for c, n in (("subject", "subject"), ("document_id", "doc"), ("level", "level"))], *more)
    return side("loser", "winner_id").filter("winner_id IS NOT NULL").join(side("winner"), ["query_id", "winner_id"])
