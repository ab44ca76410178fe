"""Fill-in-the-middle texts: cut into prefix, middle and suffix at word borders that the document's id chooses, and put back together.

All of it is column functions: a regular expression makes the array of units, hexadecimal digits of a hash choose the form and the two
cuts, slices of the array make the three parts, and restoring splits at the sentinels.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit: a word with the spaces before it, or the spaces at the end.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SENTINELS = ("<P>", "<S>", "<M>")


def _checked(sentinels: tuple[str, str, str]) -> tuple[str, str, str]:
    """ValueError unless each sentinel starts with a character that stands nowhere else in any of them.

    With that, whatever text stands beside a sentinel, no other occurrence can overlap it.
    """
    if len(set(sentinels)) < 3 or not all(sentinels) or any(s[0] in t[1:] for s in sentinels for t in sentinels):
        raise ValueError(f"sentinels {sentinels} could overlap")
    return sentinels


def _numbers(seed: int, doc_id: Column) -> list[Column]:
    """The first four 8-digit groups of the hash of seed and id, as numbers."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("long").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def fill_in_middle(docs: DataFrame, seed: int = 42, percent: int = 50, spm_percent: int = 80, sentinels: tuple[str, str, str] = SENTINELS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each row of docs: doc_id, n (units), form, prefix_chars, middle_chars, output.

    Of the texts, `percent` in a hundred are cut, and of these `spm_percent` in a hundred have their suffix first (spm), the others
    their prefix (psm); the rest, empty texts and texts that hold a sentinel stay plain, with null lengths. Null counts as an
    empty text, a null doc_id as an empty id. Either part may be empty. Rows that repeat an id or a text are cut each for itself, with the
    same cuts for the same id and units. Texts of any length are cut whole, one that is a single word or all spaces is one unit; an
    empty table gives an empty result; columns besides text and doc_id are not read.
    """
    p, s, m = _checked(sentinels)
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    h1, h2, h3, h4 = _numbers(seed, F.col(doc_id))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), whole.alias("_text"), h1.alias("_h1"), h2.alias("_h2"), h3.alias("_h3"), h4.alias("_h4"))
    held = reduce(or_, [F.contains("_text", F.lit(x)) for x in sentinels])
    plain = (F.col("_text") == "") | held | (F.col("_h3") % 100 >= percent)
    rows = rows.select("doc_id", "_text", "_h1", "_h2", F.when(plain, "plain").when(F.col("_h4") % 100 < spm_percent, "spm").otherwise("psm").alias("form"), F.regexp_extract_all("_text", F.lit(UNIT), F.lit(0)).alias("_units"))
    rows = rows.withColumn("n", F.size("_units").cast("long"))
    a, b = F.col("_h1") % (F.col("n") + 1), F.col("_h2") % (F.col("n") + 1)
    rows = rows.select("doc_id", "_text", "form", "n", "_units", F.least(a, b).cast("int").alias("_a"), F.greatest(a, b).cast("int").alias("_b"))
    part = lambda start, n: F.when(F.col("form") != "plain", F.array_join(F.slice("_units", start, n), ""))
    rows = rows.select("doc_id", "_text", "form", "n", part(F.lit(1), F.col("_a")).alias("_pre"), part(F.col("_a") + 1, F.col("_b") - F.col("_a")).alias("_mid"), part(F.col("_b") + 1, F.col("n").cast("int") - F.col("_b")).alias("_suf"))
    psm = F.concat(F.lit(p), "_pre", F.lit(s), "_suf", F.lit(m), "_mid")
    spm = F.concat(F.lit(s), "_suf", F.lit(p), "_pre", F.lit(m), "_mid")
    output = F.when(F.col("form") == "psm", psm).when(F.col("form") == "spm", spm).otherwise(F.col("_text"))
    return rows.select("doc_id", "n", "form", F.char_length("_pre").cast("long").alias("prefix_chars"), F.char_length("_mid").cast("long").alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of this form was made from. Null where either is null."""
    p, s, m = (F.lit(x) for x in _checked(sentinels))
    part = lambda x, at, k: F.split_part(x, at, F.lit(k))
    middle = part(output, m, 2)
    psm = F.concat(part(part(output, s, 1), p, 2), middle, part(part(output, m, 1), s, 2))
    spm = F.concat(part(part(output, m, 1), p, 2), middle, part(part(output, p, 1), s, 2))
    return F.when(form == "psm", psm).when(form == "spm", spm).when(form == "plain", output)
