"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations alone.

A source's target over its size is the number of copies that each of its documents should have. The whole part is certain; the
fractions are rounded together: two documents with fractional masses (fraction times words) meet, and mass moves between them at
random, with both expectations unchanged, until one of them has none or all of its words. The other goes on with what is left.
Words move, not fractions of copies, so that a source's taken words stay at the target.
Documents meet in a reduction tree: first within hash blocks of about BLOCK documents of like size, then the blocks'
residuals of each size class, so that no task sees more than a block and a hot source is many blocks. About SPARE documents of
each class stay out of the tree. They and the classes' residuals, some hundreds a source at most, are settled from large to small,
each against all smaller ones together, so that what is left over in the end is the rounding of a small document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadastra.llm.common import WORD, cut, uniform

#: Documents of a block on average.
BLOCK = 128
#: Size classes for each doubling of the size.
FINE = 4
#: Documents of each source and size class that are settled last, on average.
SPARE = 4


def _ranked(stats: DataFrame) -> DataFrame:
    """stats with _rank, from 0, by source in order of code points, null last: a distributed sort, and a count for each of its partitions."""
    rows = stats.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8")).withColumn("_row", F.monotonically_increasing_id())
    rows = cut(rows, "mix-sources")
    part, before, offsets = F.shiftright("_row", 33), 0, []
    for r in sorted(rows.groupBy(part.alias("p")).count().collect()):
        offsets += [F.lit(r["p"]), F.lit(before - (r["p"] << 33))]
        before += r["count"]
    return rows.withColumn("_rank", F.col("_row") + (F.element_at(F.create_map(*offsets), part) if offsets else F.lit(0))).drop("_row")


def source_targets(stats: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """stats (source, source_size, ...) with target: the sources' share of all words by weight, none above most times its size.

    Sources in order of code points, null last, weigh weights[0], weights[1], ... repeating. What a stopped source can't take
    is shared again by weight among the others until none is above: the level (words for each unit of weight) rises from round to
    round, each round one sum over the sources, until no further source is stopped. Sources without words have target 0.
    """
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    rows = cut(_ranked(stats).withColumn("_w", w).drop("_rank"), "mix-weights")
    total, level, stopped = rows.agg(F.sum("source_size")).first()[0] or 0, 0.0, -1
    while True:
        over = F.col("_w") * level > F.col("source_size") * most
        n, full, heavy = rows.agg(F.count_if(over), F.sum(F.when(over, F.col("source_size")).otherwise(0)), F.sum(F.when(over, 0.0).otherwise(F.col("_w")))).first()
        if n == stopped or not heavy:
            break
        level, stopped = (total - most * full) / heavy, n
    return rows.withColumn("target", F.least(F.col("source_size") * most, F.col("_w") * level)).drop("_w")


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once."""
    return F.transform(F.array(value), then)[0]


def _fold(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """Meet the rows of each key from large to small; every document comes back, settled (done) or as the key's residual.

    rows: keys, doc_id, _key, size, base and mass, with 0 <= mass <= weight and weight = max(size, 1); _key tells rows apart. Two documents with masses a and b
    can move u = min(room of a, b) one way or v = min(a, room of b) the other; they move u with probability v / (u + v),
    else v, which keeps their sum and both expectations and makes one of them empty or full. A key has about BLOCK rows by
    construction. Each level has a seed of its own, so that a residual's next meeting doesn't depend on its last.
    """
    item = F.struct((-F.greatest("size", F.lit(1))).cast("double").alias("minus"), "_key", "doc_id", "size", "_u", "mass", "base")
    got = rows.withColumn("_u", uniform(F.col("_key"), seed=seed)).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_items"))

    def one(x, mass, done):
        return F.struct(x["minus"].alias("minus"), x["_key"].alias("_key"), x["doc_id"].alias("doc_id"), x["size"].alias("size"), x["_u"].alias("_u"), mass.alias("mass"), x["base"].alias("base"), F.lit(done).alias("done"))

    def meet(acc, x):
        hand = acc["hand"]
        a, b, wa, wb = hand["mass"], x["mass"], -hand["minus"], -x["minus"]
        u, v = F.least(wa - a, b), F.least(a, wb - b)
        none = F.lit(0.0)
        to_hand = x["_u"] * (u + v) < v
        # (who goes on with what, who is settled at what)
        x_empty, hand_full = (one(hand, F.least(a + b, wa), False), one(x, none, True)), (one(x, a + b - wa, False), one(hand, wa, True))
        hand_empty, x_full = (one(x, F.least(a + b, wb), False), one(hand, none, True)), (one(hand, a + b - wb, False), one(x, wb, True))
        pick = lambda i: F.when(to_hand, F.when(b <= wa - a, x_empty[i]).otherwise(hand_full[i])).otherwise(F.when(a <= wb - b, hand_empty[i]).otherwise(x_full[i]))
        return F.struct(pick(0).alias("hand"), F.concat(acc["out"], F.array(pick(1))).alias("out"))

    first = one(F.col("_items")[0], F.col("_items")[0]["mass"], False)
    start = F.struct(first.alias("hand"), F.slice(F.array(first), 1, 0).alias("out"))
    folded = F.aggregate(F.slice(F.col("_items"), 2, F.greatest(F.size("_items") - 1, F.lit(0))), start, meet, lambda acc: F.concat(acc["out"], F.array(acc["hand"])))
    return got.select(*keys, F.explode(folded).alias("_x")).select(*keys, *[f"_x.{c}" for c in ("doc_id", "_key", "size", "base", "mass", "done")])


def _settle(rows: DataFrame, seed: int) -> DataFrame:
    """All rows of a source (source, doc_id, _key, size, base, mass) with mass brought to none or all of the document's words.

    From large to small, each document meets all that come after it: they give what it lacks or take what it has, in shares that
    are the same either way, so that all expectations stay. Where those that follow can't, the nearer end is taken
    and they make up for it as far as they can. A source has some hundreds of rows here at most.
    """
    item = F.struct((-F.greatest("size", F.lit(1))).alias("minus"), "_key", "doc_id", "size", "base", "mass", uniform(F.col("_key"), seed=seed).alias("_u"))
    got = rows.groupBy("source").agg(F.array_sort(F.collect_list(item)).alias("_items"))
    weights = lambda j: -F.col("_items")[j]["minus"].cast("double")
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)

    def step(masses: Column, i: Column) -> Column:
        a, w = masses[i], weights(i)
        after = lambda f: F.transform(masses, lambda b, j: F.when(j > i, f(b, j)).otherwise(0.0))
        moved = lambda end, by: F.transform(masses, lambda b, j: F.when(j == i, end).otherwise(F.greatest(F.lit(0.0), F.least(weights(j), b + by(b, j)))))

        def met(can: Column) -> Column:
            def fair(s: Column) -> Column:
                full, none = moved(w, lambda b, j: (a - w) * can[j] / s), moved(F.lit(0.0), lambda b, j: a * can[j] / s)
                return F.when(F.col("_items")[i]["_u"] * w < a, full).otherwise(none)

            held, room = after(lambda b, j: b), after(lambda b, j: weights(j) - b)
            give = _let(held, lambda h: _let(total(h), lambda s: moved(w, lambda b, j: F.when(s > 0, -h[j] * F.least(F.lit(1.0), (w - a) / s)).otherwise(0.0))))
            take = _let(room, lambda h: _let(total(h), lambda s: moved(F.lit(0.0), lambda b, j: F.when(s > 0, h[j] * F.least(F.lit(1.0), a / s)).otherwise(0.0))))
            return _let(total(can), lambda s: F.when(s >= 1, fair(s)).when(2 * a >= w, give).otherwise(take))

        can = after(lambda b, j: F.least(b / (w - a), (weights(j) - b) / a))
        return F.when((a <= 0) | (a >= w), masses).otherwise(_let(can, met))

    masses = F.aggregate(F.sequence(F.lit(0), F.size("_items") - 1), F.transform("_items", lambda x: x["mass"]), step)
    both = got.select("source", F.arrays_zip("_items", masses.alias("_mass")).alias("_z")).select("source", F.explode("_z").alias("_z"))
    return both.select("source", *[F.col(f"_z._items.{c}").alias(c) for c in ("doc_id", "_key", "size", "base")], F.col("_z._mass").alias("mass"))


def mix(docs: DataFrame, seed: int = 11, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, doc_id: str = "doc_id") -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, taken.

    size is the number of words (null text: 0), taken is copies times size, copies is the floor or the ceiling of target over
    source_size and so at most `most`. The result depends on rows and seed alone; only which of several rows with the same doc_id
    and text is taken follows their order in the files. A repeated doc_id is a row of its own, as is a null one;
    a null source is one source, the last; sources without words get no copies. An empty table gives an empty result. Texts of
    any length count whole. Columns besides doc_id, text and source are not read.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(F.col(doc_id), F.col("text")).alias("_key"), F.monotonically_increasing_id().alias("_row"))
    # size classes: FINE for each doubling
    rows = cut(rows.withColumn("_class", F.when(F.col("size") > 0, F.floor(F.log2(F.col("size").cast("double")) * FINE)).otherwise(-1).cast("int")), "mix-sizes")
    again = cut(rows.groupBy("_key").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("_key").alias("_again")), "mix-repeated")
    if not again.isEmpty():  # rows that can't be told apart by themselves go apart by their places
        rows = rows.join(again, F.col("_key") == F.col("_again"), "left")
        rows = cut(rows.withColumn("_key", F.when(F.col("_again").isNull(), F.col("_key")).otherwise(F.xxhash64("_key", "_row"))).drop("_again"), "mix-apart")
    classes = rows.groupBy("source", "_class").agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    classes = cut(classes, "mix-classes")
    plan = source_targets(classes.groupBy("source").agg(F.sum("_size").alias("source_size")), weights, most)
    plan = plan.withColumn("_e", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(most))).otherwise(0.0))
    plan = classes.alias("a").join(plan.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source"))).select("a.source", "_class", "_n", "source_size", "target", "_e", F.ceil(F.col("_n") / BLOCK).cast("long").alias("_blocks"))
    plan = cut(plan, "mix-plan")
    levels = plan.agg(F.max("_blocks")).first()[0] or 1

    joined = rows.alias("r").join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")) & (F.col("r._class") == F.col("p._class")))
    item = joined.select("r.doc_id", "r._key", "r.source", "r.size", "r._class", "_blocks", F.floor("_e").cast("long").alias("base"), ((F.col("_e") - F.floor("_e")) * F.greatest("size", F.lit(1))).alias("mass"), (uniform(F.col("r._key"), seed=seed + 2) * F.col("_n") < SPARE).alias("_spare"))
    item = item.withColumn("_block", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_key")), F.col("_blocks")))
    keys, columns = ["source", "_class", "_block"], ["doc_id", "_key", "size", "base", "mass"]
    # Level 0 reads all documents, the next a BLOCK-th of them, and so on.
    folded = cut(_fold(item.filter("not _spare").select(*keys, *columns), keys, seed + 10), "mix-level")
    done, left = [folded.filter("done")], folded.filter(~F.col("done"))
    level = 0
    while levels > 1:
        levels, level = -(-levels // BLOCK), level + 1
        left = left.withColumn("_block", F.floor(F.col("_block") / BLOCK))
        folded = cut(_fold(left.drop("done"), keys, seed + 10 + level), "mix-level")
        done.append(folded.filter("done"))
        left = folded.filter(~F.col("done"))
    out = _settle(left.select("source", *columns).unionByName(item.filter("_spare").select("source", *columns)), seed + 3)
    for part in done:
        out = out.unionByName(part.select("source", *columns))
    per_source = plan.select("source", "source_size", "target").distinct()
    out = out.alias("o").join(per_source.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source")))
    copies = F.col("base") + (F.col("mass") > 0.5 * F.greatest("size", F.lit(1))).cast("long")
    return out.select("doc_id", "o.source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))
