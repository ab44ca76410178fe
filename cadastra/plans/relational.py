"""Projections, filters, joins, aggregates, windows and set operations on the property and attribute tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadastra.functions.text import lga_normalise
from cadastra.operators.layers import bucketed, wide_table
from cadastra.operators.relational import contains_ilike, descendants, first_by, joined_distinct, joined_ordered, left_join_all, state_filter
from cadastra.plans.registry import query
from cadastra.sources.tables import flattened, table


@query("SELECT p_partkey AS id, p_name AS subject, p_brand AS document_id, p_retailprice AS numeric_value FROM part")
def proj_rename(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("subject"), F.col("p_brand").alias("document_id"), F.col("p_retailprice").alias("numeric_value"))


@query("SELECT * EXCLUDE (c_acctbal, c_mktsegment) FROM customer")
def proj_except(spark, d):
    return table(spark, d, "customer").drop("c_acctbal", "c_mktsegment")


@query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%RED%'")
def filter_ilike(spark, d):
    return table(spark, d, "part").filter(contains_ilike(F.col("p_name"), "RED")).select("p_partkey", "p_name")


_LGA = "CASE WHEN c_nationkey % 5 = 4 THEN NULL WHEN c_nationkey % 2 = 0 THEN 'CITY OF ' || n_name ELSE n_name || ' SHIRE COUNCIL' END"
_BARE = r"lower(trim(regexp_replace(regexp_replace(regexp_replace({c}, '^(city of|shire of|municipality of|council of)\s+', '', 'i'), '\s+(city council|regional council|shire council|council|city|shire)$', '', 'i'), '\s+', ' ', 'g')))"


def _councils(spark, d):
    key, name = F.col("c_nationkey"), F.col("n_name")
    lga = F.when(key % 5 == 4, None).when(key % 2 == 0, F.concat(F.lit("CITY OF "), name)).otherwise(F.concat(name, F.lit(" SHIRE COUNCIL")))
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", lga.alias("lga_name"))


@query(f"SELECT c_custkey, lga_name, {_BARE.format(c='lga_name')} AS bare FROM (SELECT c_custkey, {_LGA} AS lga_name FROM customer JOIN nation ON c_nationkey = n_nationkey)", name="lga_normalise")
def lga_normalise_names(spark, d):
    return _councils(spark, d).withColumn("bare", lga_normalise(F.col("lga_name")))


@query(f"SELECT c_custkey, lga_name FROM (SELECT c_custkey, {_LGA} AS lga_name FROM customer JOIN nation ON c_nationkey = n_nationkey) WHERE lga_name IS NULL OR contains({_BARE.format(c='lga_name')}, 'nation_1')")
def filter_lga(spark, d):
    return _councils(spark, d).filter(state_filter(F.col("lga_name"), "Municipality of NATION_1"))


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def join_left(spark, d):
    pending = table(spark, d, "orders").filter("o_orderstatus = 'P'")
    return table(spark, d, "customer").join(pending, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey", "o_totalprice")


@query("SELECT l_orderkey, l_linenumber, p_name, s_name FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey")
def join_threeway(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "p_name", "s_name")


_LAYER = """SELECT l_orderkey, string_agg(DISTINCT {x}, ', ' ORDER BY {x}) AS {n} FROM lineitem JOIN part ON l_partkey = p_partkey WHERE {x} IS NOT NULL GROUP BY l_orderkey"""


def _layer(spark, d, source, name):
    """One attribute layer: joined to its lot, renamed by configuration, and brought to one row a lot."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).filter(F.col(source).isNotNull())
    return lines.groupBy("l_orderkey").agg(joined_distinct(F.col(source)).alias(name))


@query(_LAYER.format(x="p_brand", n="zones"))
def layer_agg(spark, d):
    return _layer(spark, d, "p_brand", "zones")


@query("""SELECT o_custkey, string_agg(o_orderstatus, ' | ' ORDER BY o_orderdate, o_orderkey) AS history, string_agg(strftime(o_orderdate, '%Y-%m-%d'), ' | ' ORDER BY o_orderdate, o_orderkey) AS commenced
          FROM orders WHERE o_orderdate::VARCHAR NOT LIKE '9999%' GROUP BY o_custkey""")
def layer_history_agg(spark, d):
    rows = table(spark, d, "orders").filter(~F.col("o_orderdate").cast("string").like("9999%"))
    by = [F.col("o_orderdate"), F.col("o_orderkey")]
    return rows.groupBy("o_custkey").agg(joined_ordered(F.col("o_orderstatus"), by).alias("history"), joined_ordered(F.date_format("o_orderdate", "yyyy-MM-dd"), by).alias("commenced"))


@query("""SELECT l_orderkey, max(p_size) AS width, max(l_quantity) AS depth, string_agg(DISTINCT p_type, ', ' ORDER BY p_type) AS kinds
          FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey""")
def layer_max_and_string(spark, d):
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return lines.groupBy("l_orderkey").agg(F.max("p_size").alias("width"), F.max("l_quantity").alias("depth"), joined_distinct(F.col("p_type")).alias("kinds"))


@query(f"""WITH z AS ({_LAYER.format(x="p_brand", n="zones")}), t AS ({_LAYER.format(x="p_type", n="kinds")}), n AS ({_LAYER.format(x="p_name", n="names")}),
           s AS (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS flags, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey)
           SELECT o_orderkey, o_custkey, zones, kinds, names, flags, n_lines FROM orders LEFT JOIN z ON z.l_orderkey = o_orderkey LEFT JOIN t ON t.l_orderkey = o_orderkey
           LEFT JOIN n ON n.l_orderkey = o_orderkey LEFT JOIN s ON s.l_orderkey = o_orderkey""")
def comprehensive_wide(spark, d):
    """Layers that come from one source are brought together in one pass over it, then joined to the lots."""
    lines = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"), "left")
    named = [("p_brand", "zones"), ("p_type", "kinds"), ("p_name", "names"), ("l_returnflag", "flags")]
    wide = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(*[joined_distinct(F.col(a)).alias(b) for a, b in named], F.count("*").alias("n_lines"))
    return left_join_all(table(spark, d, "orders").select("o_orderkey", "o_custkey"), [wide], ["o_orderkey"])


@query("SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_customers, count(DISTINCT o_orderdate) AS n_days FROM orders")
def agg_counts(spark, d):
    return table(spark, d, "orders").agg(F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_customers"), F.count_distinct("o_orderdate").alias("n_days"))


@query("""SELECT l_orderkey, count(DISTINCT l_partkey || '/' || l_suppkey) AS lots FROM lineitem GROUP BY l_orderkey
          HAVING count(DISTINCT l_partkey || '/' || l_suppkey) > 1 ORDER BY lots DESC, l_orderkey LIMIT 5""")
def multi_lot(spark, d):
    lots = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_distinct(F.concat_ws("/", "l_partkey", "l_suppkey")).alias("lots"))
    return lots.filter("lots > 1").orderBy(F.desc("lots"), "l_orderkey").limit(5)


@query("SELECT DISTINCT p_brand AS zone, p_type || ' ' || p_name AS use FROM part")
def permissible_uses(spark, d):
    return table(spark, d, "part").select(F.col("p_brand").alias("zone"), F.concat_ws(" ", "p_type", "p_name").alias("use")).distinct()


@query("""SELECT l_partkey, l_orderkey, l_linenumber, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS r FROM lineitem) WHERE r = 1""")
def distinct_on_lots(spark, d):
    order = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")]
    return first_by(table(spark, d, "lineitem"), ["l_partkey"], order).select("l_partkey", "l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_custkey || '/' || CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderstatus END || '/' || o_orderpriority AS lot FROM orders")
def lot_key(spark, d):
    section = F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.lit(""))
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.col("o_custkey").cast("string"), F.lit("/"), section, F.lit("/"), F.col("o_orderpriority")).alias("lot"))


@query("SELECT o_orderkey, o_custkey, count(*) OVER (PARTITION BY o_custkey) AS n_addresses FROM orders")
def win_count(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", F.count("*").over(Window.partitionBy("o_custkey")).alias("n_addresses"))


@query("SELECT c_mktsegment AS category, count(*) AS n_items, sum(CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END) AS n_open FROM customer GROUP BY c_mktsegment")
def category_counts(spark, d):
    return table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("category")).agg(F.count("*").alias("n_items"), F.sum(F.when(F.col("c_acctbal") > 0, 1).otherwise(0)).alias("n_open"))


@query("""SELECT o_orderpriority, count(*) FILTER (o_orderstatus = 'F') AS done, count(*) FILTER (o_orderstatus <> 'F') AS waiting,
          round(coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0), 2) AS done_price FROM orders GROUP BY o_orderpriority""")
def agg_conditional(spark, d):
    done = F.col("o_orderstatus") == "F"
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count_if(done).alias("done"), F.count_if(~done).alias("waiting"), F.round(F.coalesce(F.sum(F.when(done, F.col("o_totalprice"))), F.lit(0.0)), 2).alias("done_price")
    )


@query("SELECT s_suppkey AS id, 'supplier' AS source FROM supplier UNION ALL SELECT n_nationkey, 'nation' FROM nation")
def union_sources(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.lit("supplier").alias("source"))
    return a.unionByName(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.lit("nation").alias("source")))


_USES = """u AS (SELECT p_brand AS zone, p_type AS use FROM part GROUP BY ALL),
           p AS (SELECT l_orderkey, string_agg(DISTINCT p_brand, ', ' ORDER BY p_brand) AS zones FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)"""


@query(f"""WITH {_USES}, z AS (SELECT l_orderkey, trim(unnest(string_split(zones, ','))) AS zone FROM p)
           SELECT p.l_orderkey, zones, string_agg(DISTINCT use, ', ' ORDER BY use) AS uses FROM p LEFT JOIN z ON z.l_orderkey = p.l_orderkey LEFT JOIN u ON u.zone = z.zone GROUP BY p.l_orderkey, zones""")
def zone_uses_enrich(spark, d):
    part = table(spark, d, "part")
    uses = part.select(F.col("p_brand").alias("zone"), F.col("p_type").alias("use")).distinct()
    zones = table(spark, d, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey")).filter("p_brand is not null").select("l_orderkey", F.col("p_brand").alias("zone")).distinct()
    return zones.join(uses, "zone", "left").groupBy("l_orderkey").agg(joined_distinct(F.col("zone")).alias("zones"), joined_distinct(F.col("use")).alias("uses"))


@query("""WITH t AS (SELECT p_brand, string_agg(DISTINCT p_name, ' | ' ORDER BY p_name) AS names, count(*) AS n FROM part GROUP BY p_brand) SELECT p_brand, names, n::VARCHAR AS n FROM t""")
def sink_flatten_arrays(spark, d):
    return flattened(table(spark, d, "part").groupBy("p_brand").agg(F.array_sort(F.collect_set("p_name")).alias("names"), F.count("*").alias("n")))


@query("""WITH t AS (SELECT p_brand, string_agg(DISTINCT p_name, ' , ' ORDER BY p_name) AS names FROM part GROUP BY p_brand)
          SELECT p_brand, trim(unnest(string_split(names, ','))) AS name FROM t""")
def csv_list(spark, d):
    lists = table(spark, d, "part").groupBy("p_brand").agg(joined_distinct(F.col("p_name"), " , ").alias("names"))
    items = F.filter(F.transform(F.split("names", ","), lambda x: F.trim(x)), lambda x: x != "")
    return lists.select("p_brand", F.explode(items).alias("name"))


@query("""WITH RECURSIVE e AS (SELECT 'r' || r_regionkey AS child, NULL AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer),
          t AS (SELECT child AS id, child AS root, 0 AS depth FROM e WHERE parent IS NULL UNION ALL SELECT e.child, t.root, t.depth + 1 FROM e JOIN t ON e.parent = t.id)
          SELECT id, root, depth FROM t""")
def tree_children(spark, d):
    """Children with their root and depth, a join for each level."""
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    nations = table(spark, d, "nation").select(name("n", "n_nationkey").alias("child"), name("r", "n_regionkey").alias("parent"))
    customers = table(spark, d, "customer").select(name("c", "c_custkey").alias("child"), name("n", "c_nationkey").alias("parent"))
    roots = table(spark, d, "region").select(name("r", "r_regionkey").alias("child"), F.lit(None).cast("string").alias("parent"))
    return descendants(roots.unionByName(nations).unionByName(customers))


_LAYERS = [f"l{i} AS (SELECT l_suppkey, l_returnflag, max(l_quantity) AS most_{i}, count(*) AS n_{i} FROM lineitem WHERE l_linenumber = {i} GROUP BY ALL)" for i in range(1, 8)] + ["l8 AS (SELECT l_suppkey, l_returnflag, string_agg(DISTINCT l_linestatus, ', ' ORDER BY l_linestatus) AS statuses FROM lineitem GROUP BY ALL)"]
_TABLES: dict[tuple[str, str], tuple[str, list[str]]] = {}


@query(f"WITH {', '.join(_LAYERS)} SELECT l_suppkey, l_returnflag, {', '.join(f'most_{i}, n_{i}' for i in range(1, 8))}, statuses FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM lineitem) " + " ".join(f"LEFT JOIN l{i} USING (l_suppkey, l_returnflag)" for i in range(1, 9)))
def wide_layers(spark, d):
    """Eight layers on two keys, written in buckets once in a session and merged without a shuffle."""
    keys, at = ["l_suppkey", "l_returnflag"], (spark.sparkContext.applicationId, d)
    if at not in _TABLES:
        lines, name = table(spark, d, "lineitem"), f"wide_{uuid.uuid4().hex[:12]}"
        layers = [lines.filter(F.col("l_linenumber") == i).groupBy(*keys).agg(F.max("l_quantity").alias(f"most_{i}"), F.count("*").alias(f"n_{i}")) for i in range(1, 8)]
        layers.append(lines.groupBy(*keys).agg(joined_distinct(F.col("l_linestatus")).alias("statuses")))
        made = [bucketed(x, f"{name}_{i}", keys, 8) for i, x in enumerate([lines.select(*keys).distinct(), *layers])]
        _TABLES[at] = made[0], made[1:]
    return wide_table(spark, *_TABLES[at], keys)
