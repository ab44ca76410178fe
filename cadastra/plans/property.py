"""Property lookups, spatial analogues, assessment rules and unpivots."""

from __future__ import annotations

import re
from pyspark.sql import Window
from pyspark.sql import functions as F

from cadastra.functions.projection import FORTH, from_zone, to_zone
from cadastra.functions.text import plural_hit, subjects_equivalent
from cadastra.operators.containment import grams, meeting
from cadastra.operators.relational import all_of, contains_ilike, first_by
from cadastra.operators.spatial import box_join, geometry_join, nearest, wkb_of
from cadastra.operators.reports import assess, fact_block, pattern_rows, property_lookup, question_cards
from cadastra.plans.registry import query
from cadastra.sources.tables import table, written


def address_search(properties, text: str, most: int = 10):
    """Addresses for what a user has typed: all its words must occur, the street number ranks; under three characters nothing.

    properties: address and what else is to be returned. An exact street number comes first (also behind a unit), then the nearest
    number, then the address.
    """
    norm = re.sub(r"\s+", " ", text.upper().replace(",", " ")).strip()
    tokens = [t for t in norm.split(" ") if len(t) >= 2]
    if len(text.strip()) < 3 or not tokens:
        return properties.withColumns({"_exact": F.lit(0), "_dist": F.lit(0)}).limit(0)
    words, digits = [t for t in tokens if not t[0].isdigit()], re.findall(r"\d+", norm)
    wanted = words or digits[:1]
    rows = properties.filter(all_of([contains_ilike(F.col("address"), t) for t in wanted]))
    street = re.match(r"(?:\d+[A-Z]?\s*/\s*)?(\d+)", norm)
    if street:
        n = street[1]
        own = F.coalesce(*[F.try_to_number(F.nullif(F.regexp_extract("address", p, 1), F.lit("")), F.lit("999999999999")) for p in (r"^[0-9]+[A-Za-z]?\s*/\s*([0-9]+)", r"^([0-9]+)")], F.lit(999999)).cast("long")
        exact = F.col("address").rlike(rf"^[0-9]+[A-Za-z]?\s*/\s*{n}[A-Za-z]?\s") | F.col("address").rlike(rf"^{n}[A-Za-z]?\s")
        rows = rows.withColumns({"_exact": F.when(exact, 0).otherwise(1), "_dist": F.abs(own - F.lit(int(n)))})
    else:
        rows = rows.withColumns({"_exact": F.lit(0), "_dist": F.lit(0).cast("long")})
    return first_by(rows, ["address"], [F.col(c) for c in rows.columns if c != "address"]).orderBy("_exact", "_dist", "address").limit(most)


@query("""WITH a AS (SELECT (c_custkey % 900 + 1) || ' ' || c_mktsegment || ' STREET NATION ' || c_nationkey AS address, min(c_custkey) AS id FROM customer GROUP BY 1)
          SELECT address, id, CASE WHEN regexp_matches(address, '^505[A-Za-z]?\\s') THEN 0 ELSE 1 END AS _exact, abs(regexp_extract(address, '^([0-9]+)', 1)::BIGINT - 505) AS _dist
          FROM a WHERE address ILIKE '%BUILDING%' AND address ILIKE '%STREET%' ORDER BY _exact, _dist, address LIMIT 10""")
def addr_autocomplete(spark, d):
    c = F.col
    address = F.concat(((c("c_custkey") % 900) + 1).cast("string"), F.lit(" "), c("c_mktsegment"), F.lit(" STREET NATION "), c("c_nationkey").cast("string"))
    rows = table(spark, d, "customer").groupBy(address.alias("address")).agg(F.min("c_custkey").alias("id"))
    return address_search(rows, "505 Building, Street")


def title_search(rows, text: str, column: str = "title"):
    """The rows whose title holds the text, whatever the case; all rows for an empty text."""
    return rows.filter(F.lower(F.col(column)).contains(text.strip().lower())) if text.strip() else rows


@query("SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'bolt')")
def doc_title_search(spark, d):
    return title_search(table(spark, d, "part").select("p_partkey", "p_name"), " Bolt", "p_name")


@query("SELECT p_partkey, p_name, round(power(p_size - 25, 2) + power(p_retailprice - 1200, 2), 6) AS d FROM part ORDER BY d, p_partkey LIMIT 1")
def knn_point(spark, d):
    dist = F.round(F.pow(F.col("p_size") - 25, 2) + F.pow(F.col("p_retailprice") - 1200, 2), 6)
    return table(spark, d, "part").select("p_partkey", "p_name", dist.alias("d")).orderBy("d", "p_partkey").limit(1)


@query("SELECT c_custkey, c_name FROM customer WHERE c_name = 'Customer#000000042' LIMIT 1")
def prop_lookup_exact(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("address"))
    return property_lookup(rows, "Customer#000000042").select("c_custkey", F.col("address").alias("c_name"))


@query("""WITH x AS (SELECT s_suppkey AS id, c_mktsegment AS kind, c_custkey AS place_id, round(sqrt(power(s_acctbal - c_acctbal, 2) + power(s_nationkey * 100.0 - c_nationkey * 100.0, 2)), 6) AS distance FROM supplier CROSS JOIN customer),
          r AS (SELECT *, row_number() OVER (PARTITION BY id, kind ORDER BY distance, place_id) AS n FROM x) SELECT id, kind, place_id, distance FROM r WHERE n = 1""")
def nearest_per_group(spark, d):
    points = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("x"), (F.col("s_nationkey") * 100.0).alias("y"))
    places = table(spark, d, "customer").select(F.col("c_custkey").alias("place_id"), F.col("c_acctbal").alias("x"), (F.col("c_nationkey") * 100.0).alias("y"), F.col("c_mktsegment").alias("kind"))
    return nearest(points, places, "kind", digits=6)


@query("""SELECT p_partkey AS a_id, s_suppkey AS b_id FROM part JOIN supplier ON p_retailprice <= s_acctbal + 20 AND s_acctbal <= p_retailprice + 10 AND p_size <= s_nationkey + 2 AND s_nationkey <= p_size + 1""")
def spatial_bbox_join(spark, d):
    box = lambda t, i, x, y, w, h: table(spark, d, t).select(F.col(i).alias("id"), F.col(x).alias("x0"), F.col(y).alias("y0"), (F.col(x) + w).alias("x1"), (F.col(y) + h).alias("y1"))
    return box_join(box("part", "p_partkey", "p_retailprice", "p_size", 10, 1), box("supplier", "s_suppkey", "s_acctbal", "s_nationkey", 20, 2), 50.0)


@query(r"""WITH u AS (SELECT DISTINCT p_brand AS zone, p_type || ', ' || p_name AS use FROM part), n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(use), '[^a-z0-9 ]', '', 'g'), '\s+', ' ', 'g')) AS hay FROM u),
           m AS (SELECT zone, use FROM n WHERE contains(hay, 'small bolt') OR contains('small bolt', hay) OR split_part(hay, ' ', 1) = 'small')
           SELECT z.zone, CASE WHEN count(m.use) > 0 THEN 'permitted' ELSE 'not_found' END AS status, string_agg(m.use, ' | ' ORDER BY m.use) AS matched
           FROM (SELECT DISTINCT zone FROM u) z LEFT JOIN m ON m.zone = z.zone GROUP BY z.zone""")
def permissibility_match(spark, d):
    uses = table(spark, d, "part").select(F.col("p_brand").alias("zone"), F.concat_ws(", ", "p_type", "p_name").alias("use")).distinct()
    return permissibility(uses, "Small bolt")


def permissibility(uses, land_use: str):
    """(zone, status, matched): whether a use is among those listed for each zone; contained either way or with the same first word."""
    if not land_use.strip():
        raise ValueError("a land use is required")
    needle = re.sub(r"\s+", " ", re.sub(r"[^a-z0-9 ]", "", land_use.lower())).strip()
    hay = F.trim(F.regexp_replace(F.regexp_replace(F.lower("use"), "[^a-z0-9 ]", ""), r"\s+", " "))
    hit = F.contains(hay, F.lit(needle)) | F.contains(F.lit(needle), hay) | (F.split_part(hay, F.lit(" "), F.lit(1)) == needle.split(" ")[0])
    found = uses.groupBy("zone").agg(F.array_sort(F.collect_list(F.when(hit, F.col("use")))).alias("m"))
    return found.select("zone", F.when(F.size("m") > 0, "permitted").otherwise("not_found").alias("status"), F.when(F.size("m") > 0, F.array_join("m", " | ")).alias("matched"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN r < 1 THEN 'under' WHEN r >= 2 THEN 'exceeds' ELSE 'meets' END AS lot_band, CASE WHEN q < 12 THEN 'narrow' WHEN q >= 15 THEN 'wide' ELSE 'between' END AS frontage_band,
          round(a * f) AS gfa, floor(nullif(h, 0) / 3.1) AS storeys, n AS n_constraints, CASE WHEN l_linestatus = 'O' AND n = 0 THEN 'viable' WHEN l_linestatus = 'O' THEN 'verify' ELSE 'application' END AS pathway
          FROM (SELECT *, l_quantity AS q, l_extendedprice AS a, 1 + l_tax AS f, l_linenumber * 2.5 AS h, l_extendedprice / 30000.0 AS r, (l_returnflag = 'R')::INT + (l_discount > 0.05)::INT + (l_tax > 0.06)::INT AS n FROM lineitem)""")
def assess_flags(spark, d):
    """Lines as properties: price as area, quantity as frontage, line number as height, three flags as constraints."""
    c, some = F.col, lambda x: F.when(x, "yes")
    rows = table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", c("l_extendedprice").alias("area_sqm"), F.lit(30000.0).alias("min_lot_size"), c("l_quantity").alias("frontage_m"), (1 + c("l_tax")).alias("fsr_value"),
        (c("l_linenumber") * 2.5).alias("max_height_m"), some(c("l_returnflag") == "R").alias("floodmapping"), some(c("l_discount") > 0.05).alias("biodiversity"), some(c("l_tax") > 0.06).alias("acid_sulfate"),
        (c("l_linestatus") == "O").cast("string").alias("cdc_eligible"),
    )
    return assess(rows, ["l_orderkey", "l_linenumber", "l_partkey"])


# Constraints with the column that tells of each, its label and severity.
CONSTRAINTS = [
    ("floodmapping", "Flood", "high"), ("bushfireproneland", "Bushfire", "high"), ("contamination_sitename", "Contamination", "high"), ("mine_subsidence_district", "Mine subsidence", "high"),
    ("biodiversity", "Biodiversity", "medium"), ("landsliderisk", "Landslide risk", "medium"), ("coastal_wetlands", "Coastal wetlands", "medium"), ("coastal_environment_area", "Coastal environment", "medium"),
    ("coastal_use_area", "Coastal use area", "medium"), ("riparianlandwatercourse", "Riparian/watercourse", "medium"), ("drinking_water_catchment", "Drinking water catchment", "medium"),
    ("scenicprotectionland", "Scenic protection", "medium"), ("groundwatervulnerability", "Groundwater vulnerability", "low"), ("acid_sulfate", "Acid sulfate soils", "low"),
]
# Complying-development pathways by column suffix.
PATHWAYS = ["general", "dwelling_houses", "dual_occupancy", "secondary_dwellings", "multi_dwelling_terraces", "manor_homes", "greenfield_housing", "rural_housing", "agritourism", "farmstay"]


def constraint_rows(properties, key: str):
    """(key, label, severity): a row for each constraint that a property has; `No` is none for flood and bushfire."""
    one = lambda c, label, severity: F.when((F.col(c) != "") & ~((F.col(c) == "No") & F.lit(c in ("floodmapping", "bushfireproneland"))), F.struct(F.concat(F.lit(f"{label}: "), F.col(c)).alias("label"), F.lit(severity).alias("severity")))
    present = [one(*x) for x in CONSTRAINTS if x[0] in properties.columns]
    return properties.select(key, F.explode(F.filter(F.array(*present), lambda x: x.isNotNull())).alias("c")).select(key, "c.label", "c.severity")


def pathway_rows(properties, key: str):
    """(key, pathway, eligible, exclusions) for each pathway; flags are the text `true`."""
    rows = [F.struct(F.lit(p).alias("pathway"), F.coalesce(F.col(f"cdc_{p}") == "true", F.lit(False)).alias("eligible"), F.col(f"cdc_{p}_exclusions").alias("exclusions")) for p in PATHWAYS if f"cdc_{p}" in properties.columns]
    return properties.select(key, F.explode(F.array(*rows)).alias("p")).select(key, "p.*")


@query("""SELECT * FROM (SELECT o_orderkey, 'Flood: ' || o_orderstatus AS label, 'high' AS severity FROM orders WHERE o_orderstatus <> 'P'
          UNION ALL SELECT o_orderkey, 'Biodiversity: ' || o_orderpriority, 'medium' FROM orders WHERE o_totalprice > 250000 UNION ALL SELECT o_orderkey, 'Acid sulfate soils: class ' || (o_custkey % 5), 'low' FROM orders WHERE o_custkey % 5 > 0)""")
def constraint_unpivot(spark, d):
    c = F.col
    rows = table(spark, d, "orders").select(
        "o_orderkey", F.when(c("o_orderstatus") == "P", "No").otherwise(c("o_orderstatus")).alias("floodmapping"),
        F.when(c("o_totalprice") > 250000, c("o_orderpriority")).alias("biodiversity"), F.when(c("o_custkey") % 5 > 0, F.concat(F.lit("class "), (c("o_custkey") % 5).cast("string"))).alias("acid_sulfate"),
    )
    return constraint_rows(rows, "o_orderkey")


@query("""SELECT o_orderkey, 'general' AS pathway, o_orderstatus = 'O' AS eligible, o_orderpriority AS exclusions FROM orders UNION ALL SELECT o_orderkey, 'farmstay', o_totalprice > 300000, NULL FROM orders""")
def pathway_unpivot(spark, d):
    c = F.col
    rows = table(spark, d, "orders").select(
        "o_orderkey", (c("o_orderstatus") == "O").cast("string").alias("cdc_general"), c("o_orderpriority").alias("cdc_general_exclusions"),
        (c("o_totalprice") > 300000).cast("string").alias("cdc_farmstay"), F.lit(None).cast("string").alias("cdc_farmstay_exclusions"),
    )
    return pathway_rows(rows, "o_orderkey")


@query("""SELECT o_orderkey, concat_ws(chr(10), 'Address: ' || o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN 'Zone: ' || o_orderstatus || ' (' || o_orderpriority || ')' END, 'LEP: ' || CASE WHEN o_custkey % 3 = 0 THEN 'N/A' ELSE 'Plan ' || o_custkey END,
          'LGA: N/A', 'Council: N/A', CASE WHEN o_custkey % 5 > 0 THEN 'Min lot size: ' || (o_custkey % 5) || '00 ' || CASE WHEN o_custkey % 2 = 0 THEN 'ha' ELSE 'sqm' END END,
          CASE WHEN o_totalprice > 100000 THEN 'Lot area: ' || round(o_totalprice)::BIGINT || ' sqm' END, 'Primary frontage: ' || (o_custkey % 40) || 'm (' || CASE WHEN o_orderstatus = 'O' THEN 'High St' ELSE '' END || ')',
          CASE WHEN o_orderstatus = 'O' THEN 'Corner lot: Yes' END, CASE WHEN o_orderstatus = 'F' THEN 'Battle-axe lot: Yes' END, CASE WHEN o_custkey % 7 = 0 THEN 'Heritage: Item ' || o_custkey || ' (State)' END,
          CASE WHEN o_totalprice > 200000 THEN 'CDC eligible: Yes (' || (o_custkey % 4) || ' pathways)' ELSE 'CDC eligible: No' END, CASE WHEN o_orderstatus = 'O' THEN 'CDC dwelling houses: eligible' END, CASE WHEN o_orderstatus = 'F' THEN 'CDC dual occupancy: eligible' END,
          CASE WHEN o_orderstatus = 'P' THEN 'CDC secondary dwellings: eligible' END, CASE WHEN o_totalprice > 200000 THEN 'In Low-Mid Rise housing area: Yes' END, 'DCP: ' || o_orderpriority) AS block FROM orders""")
def fact_lines(spark, d):
    c = F.col
    is_ = lambda x: x.cast("string")
    rows = table(spark, d, "orders").select(
        "o_orderkey", c("o_orderkey").alias("address"), F.when(c("o_orderstatus") != "P", c("o_orderstatus")).otherwise("").alias("zone"), c("o_orderpriority").alias("zone_class"), c("o_orderpriority").alias("dcp_plan_name"),
        F.when(c("o_custkey") % 3 > 0, F.concat(F.lit("Plan "), is_(c("o_custkey")))).alias("lep_name"), F.when(c("o_custkey") % 5 > 0, c("o_custkey") % 5 * 100).alias("min_lot_size"), F.when(c("o_custkey") % 2 == 0, "ha").alias("lot_size_units"),
        F.when(c("o_totalprice") > 100000, c("o_totalprice")).alias("area_sqm"), (c("o_custkey") % 40).alias("primary_frontage_length_m"), F.when(c("o_orderstatus") == "O", "High St").alias("primary_frontage_road"),
        is_(c("o_orderstatus") == "O").alias("is_corner_lot"), is_(c("o_orderstatus") == "F").alias("is_battleaxe"), F.when(c("o_custkey") % 7 == 0, F.concat(F.lit("Item "), is_(c("o_custkey")))).alias("heritage_name"), F.lit("State").alias("heritage_class"),
        is_(c("o_totalprice") > 200000).alias("cdc_eligible"), (c("o_custkey") % 4).alias("total_cdc_eligible"), is_(c("o_orderstatus") == "O").alias("cdc_dwelling_houses"), is_(c("o_orderstatus") == "F").alias("cdc_dual_occupancy"),
        is_(c("o_orderstatus") == "P").alias("cdc_secondary_dwellings"), is_(c("o_totalprice") > 200000).alias("in_lmr_housing_area"),
    )
    return fact_block(rows, "o_orderkey")


@query("""SELECT o_orderkey, p.pattern, p.eligible FROM (SELECT o_orderkey, o_orderpriority LIKE '1%' AS lmr, unnest([{'pattern': 'semis_01_anthony_gill', 'eligible': o_orderstatus = 'O'}, {'pattern': 'semis_02_sibling', 'eligible': false}, {'pattern': 'manor_homes_01_studio', 'eligible': false},
          {'pattern': 'row_homes_01_saha', 'eligible': false}, {'pattern': 'terraces_01_carter', 'eligible': o_totalprice > 300000}, {'pattern': 'terraces_02_sam_crawford', 'eligible': false}, {'pattern': 'terraces_03_officer_woods', 'eligible': false}, {'pattern': 'terraces_04_other', 'eligible': false}]) AS p FROM orders)
          WHERE p.eligible OR lmr""")
def pattern_unpivot(spark, d):
    c = F.col
    rows = table(spark, d, "orders").select("o_orderkey", c("o_orderpriority").startswith("1").cast("string").alias("in_lmr_housing_area"), (c("o_orderstatus") == "O").cast("string").alias("semis_01_anthony_gill_eligible"), (c("o_totalprice") > 300000).cast("string").alias("terraces_01_carter_eligible"))
    return pattern_rows(rows, "o_orderkey")


@query("""SELECT c_custkey, c_name FROM customer ORDER BY power(c_acctbal - 1000.5, 2) + power(c_nationkey - 7.25, 2), c_name LIMIT 1""")
def prop_lookup_point(spark, d):
    rows = table(spark, d, "customer").select("c_custkey", F.col("c_name").alias("address"), F.col("c_acctbal").alias("centroid_lat"), F.col("c_nationkey").alias("centroid_lon"))
    return property_lookup(rows, lat=1000.5, lon=7.25).select("c_custkey", F.col("address").alias("c_name"))


@query("""SELECT n_nationkey, count(*) AS n_cards, count(DISTINCT card) AS n_kinds, sum(CASE WHEN contains(question, n_name || ' LEP') THEN 1 ELSE 0 END) AS n_named
          FROM (SELECT n_nationkey, n_name, unnest(['clause_46', 'subdivision', 'secondary_dwelling', 'dual_occupancy', 'setbacks_envelope', 'parking_access', 'heritage', 'contributions']) AS card FROM nation) c
          JOIN (SELECT * FROM (VALUES ('clause_46', true), ('subdivision', true), ('secondary_dwelling', false), ('dual_occupancy', true), ('setbacks_envelope', false), ('parking_access', false), ('heritage', true), ('contributions', false)) v(k, own)) v ON v.k = c.card,
          LATERAL (SELECT CASE WHEN own THEN n_name || ' LEP' ELSE '' END AS question) GROUP BY n_nationkey""")
def card_questions(spark, d):
    rows = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("lga_name"), F.lit("R2").alias("zone"))
    cards = question_cards(rows, "n_nationkey").join(rows.select("n_nationkey", "lga_name"), "n_nationkey")
    return cards.groupBy("n_nationkey").agg(F.count("*").alias("n_cards"), F.count_distinct("card").alias("n_kinds"), F.sum(F.contains("question", F.concat("lga_name", F.lit(" LEP"))).cast("int")).alias("n_named"))


def approximate_polygons(edges):
    """(id, pos, dx, dy) from edges (id, pos, metres): a closed walk that turns by 360 / n degrees at each corner, about its mean.

    Lots with fewer than three edges have no polygon. Offsets are in metres east and north; 111,320 metres make a degree.
    """
    w = Window.partitionBy("id").orderBy("pos")
    n = F.count("*").over(Window.partitionBy("id"))
    at = edges.withColumn("n", n).withColumn("k", F.row_number().over(w) - 1).filter("n >= 3").withColumn("a", 2 * F.pi() * F.col("k") / F.col("n"))
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    walk = at.withColumn("x", F.coalesce(F.sum(F.col("metres") * F.sin("a")).over(before), F.lit(0.0))).withColumn("y", F.coalesce(F.sum(F.col("metres") * F.cos("a")).over(before), F.lit(0.0)))
    whole = Window.partitionBy("id")
    return walk.select("id", "pos", (F.col("x") - F.avg("x").over(whole)).alias("dx"), (F.col("y") - F.avg("y").over(whole)).alias("dy"))


@query("""WITH e AS (SELECT l_orderkey AS id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, l_quantity AS metres FROM lineitem),
          a AS (SELECT *, count(*) OVER (PARTITION BY id) AS n FROM e), b AS (SELECT *, 2 * pi() * (pos - 1) / n AS a FROM a WHERE n >= 3),
          c AS (SELECT *, coalesce(sum(metres * sin(a)) OVER w, 0) AS x, coalesce(sum(metres * cos(a)) OVER w, 0) AS y FROM b WINDOW w AS (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
          SELECT id, pos, round(x - avg(x) OVER (PARTITION BY id), 4) + 0.0 AS dx, round(y - avg(y) OVER (PARTITION BY id), 4) + 0.0 AS dy FROM c""")
def approx_polygon(spark, d):
    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")).cast("long")
    edges = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), pos.alias("pos"), F.col("l_quantity").alias("metres"))
    out = approximate_polygons(edges)
    return out.select("id", "pos", (F.round("dx", 4) + 0.0).alias("dx"), (F.round("dy", 4) + 0.0).alias("dy"))


def use_hits(asked, uses):
    """The rows of asked (question and others, lower case) with each use that they hit: the question contains the use, or all
    tokens of the use have over three characters and each occurs in the question.

    uses: one column use, distinct. A use with long tokens waits at the rarest gram within a token, any other at its rarest gram.
    """
    rows = written(asked.withColumn("_id", F.monotonically_increasing_id()), "asked")
    wanted = written(uses.select("use", F.lower("use").alias("_use")).filter("_use <> ''").withColumn("term_id", F.xxhash64("use")), "uses")
    tokens = F.split("_use", r"\s+")
    long = F.forall(tokens, lambda t: F.char_length(t) > 3)
    parts = F.when(long, F.flatten(F.transform(tokens, lambda t: grams(t)))).otherwise(grams(F.col("_use")))
    met = meeting(rows.select(F.col("_id").alias("text_id"), F.col("question").alias("text")), wanted.select("term_id", parts.alias("grams")))
    met = rows.join(met, F.col("_id") == F.col("text_id")).join(wanted, "term_id")
    apart = F.forall(tokens, lambda t: (F.char_length(t) > 3) & F.contains(F.col("question"), t))
    return met.filter(F.contains("question", "_use") | apart).select(*asked.columns, "use")


@query(r"""WITH u AS (SELECT DISTINCT p_name AS use FROM part), q AS (SELECT p_partkey, lower(p_type || ' ' || p_name || ' works') AS question FROM part)
           SELECT p_partkey, count(*) AS n_hits FROM q JOIN u ON contains(question, use) OR len(list_filter(regexp_split_to_array(use, '\s+'), lambda t: length(t) <= 3 OR NOT contains(question, t))) = 0 GROUP BY p_partkey""")
def use_hit(spark, d):
    part = table(spark, d, "part")
    uses = part.select(F.col("p_name").alias("use")).distinct()
    asked = part.select("p_partkey", F.lower(F.concat_ws(" ", "p_type", "p_name", F.lit("works"))).alias("question"))
    return use_hits(asked, uses).groupBy("p_partkey").agg(F.count("*").alias("n_hits"))


def plural_matches(texts, terms):
    """The rows of texts (text and others, lower case) with each term (term, lower case, distinct) that stands in them, also as singular or plural.

    Whatever ending is changed, the term without it stays: both sides meet on its rarest gram.
    """
    rows = written(texts.withColumn("_id", F.monotonically_increasing_id()), "texts")
    wanted = written(terms.filter("term <> ''").withColumn("term_id", F.xxhash64("term")), "terms")
    kept = F.coalesce(F.nullif(F.regexp_replace("term", "(ies|y|s)$", ""), F.lit("")), F.col("term"))
    met = meeting(rows.select(F.col("_id").alias("text_id"), "text"), wanted.select("term_id", grams(kept).alias("grams")))
    met = rows.join(met, F.col("_id") == F.col("text_id")).join(wanted, "term_id")
    return met.filter(plural_hit(F.col("term"), F.col("text"))).select(*texts.columns, *terms.columns)


@query("""WITH t AS (SELECT DISTINCT CASE p_size % 4 WHEN 0 THEN p_name || 's' WHEN 1 THEN p_name || ' factory' WHEN 2 THEN p_name || ' factories' ELSE p_name END AS term FROM part),
          x AS (SELECT p_partkey, lower(p_type) || ' ' || p_name || CASE p_partkey % 3 WHEN 0 THEN ' factory' WHEN 1 THEN ' factories' ELSE 's allowed' END AS text FROM part)
          SELECT p_partkey, count(*) AS n_plural, min(term) AS first_term FROM x JOIN t ON contains(text, term) OR (term LIKE '%y' AND contains(text, regexp_replace(term, 'y$', 'ies'))) OR (term LIKE '%ies' AND contains(text, regexp_replace(term, 'ies$', 'y')))
          OR (term LIKE '%s' AND term NOT LIKE '%ies' AND length(term) > 4 AND contains(text, left(term, length(term) - 1))) GROUP BY p_partkey""")
def plural_match(spark, d):
    part, c = table(spark, d, "part"), F.col
    ends = lambda k, *x: F.when(k == 0, x[0]).when(k == 1, x[1]).when(k == 2, x[2]).otherwise("")
    terms = part.select(F.concat("p_name", ends(c("p_size") % 4, "s", " factory", " factories")).alias("term")).distinct()
    texts = part.select("p_partkey", F.concat(F.lower("p_type"), F.lit(" "), c("p_name"), ends(c("p_partkey") % 3, " factory", " factories", "s allowed")).alias("text"))
    return plural_matches(texts, terms).groupBy("p_partkey").agg(F.count("*").alias("n_plural"), F.min("term").alias("first_term"))


@query(r"""WITH s AS (SELECT p_partkey, p_brand, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) || ' (' || split_part(p_name, ' ', 2) || ')' END AS subject FROM part),
           n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(subject), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM s), l AS (SELECT *, lead(n) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS m FROM n)
           SELECT p_partkey, coalesce(n = m OR (length(n) >= 6 AND length(m) >= 6 AND (contains(n, m) OR contains(m, n))), false) AS same FROM l""")
def subject_match(spark, d):
    """Each part's subject against the next one's of its brand."""
    name = F.col("p_name")
    subject = F.when(F.col("p_partkey") % 2 == 0, name).otherwise(F.concat(F.upper(name), F.lit(" ("), F.split_part(name, F.lit(" "), F.lit(2)), F.lit(")")))
    rows = table(spark, d, "part").select("p_partkey", "p_brand", subject.alias("subject"))
    after = rows.withColumn("after", F.lead("subject").over(Window.partitionBy("p_brand").orderBy("p_partkey")))
    return after.select("p_partkey", F.coalesce(subjects_equivalent(F.col("subject"), F.col("after")), F.lit(False)).alias("same"))


def _square(x, y, wide, high):
    """The corners of a rectangle as in well-known text."""
    at = [(x, y), (x + wide, y), (x + wide, y + high), (x, y + high), (x, y)]
    return F.concat_ws(", ", *[F.format_string("%.6f %.6f", a.cast("double"), b.cast("double")) for a, b in at])


@query("""SELECT p_partkey AS a_id, s_suppkey AS b_id FROM part JOIN supplier ON p_size <= s_nationkey + 2 AND s_nationkey <= p_size + 1 AND round(p_retailprice) <= round(s_acctbal) + 20 AND round(s_acctbal) <= round(p_retailprice) + 10""")
def geometry_meets(spark, d):
    """Rectangles on whole coordinates: many share no more than a border or a corner, which counts."""
    return _shape_join(spark, d, 0.0)


@query("""SELECT p_partkey AS a_id, s_suppkey AS b_id FROM part JOIN supplier ON p_size < s_nationkey + 2 AND s_nationkey < p_size + 1 AND round(p_retailprice) < round(s_acctbal) + 20 AND round(s_acctbal) < round(p_retailprice) + 10""")
def geometry_meets_inset(spark, d):
    """The same with the lots drawn in, so that neighbours that only touch don't meet."""
    return _shape_join(spark, d, 0.001)


def _shape_join(spark, d, shrink):
    lots = table(spark, d, "part").select("p_partkey", F.round("p_retailprice").alias("x"), "p_size")
    zones = table(spark, d, "supplier").select("s_suppkey", F.round("s_acctbal").alias("x"), "s_nationkey")
    shape = lambda df, key, y, w, h: wkb_of(df.select(F.col(key).alias("id"), F.concat(F.lit("POLYGON (("), _square(F.col("x"), F.col(y), w, h), F.lit("))")).alias("wkt")), "wkt")
    return geometry_join(shape(lots, "p_partkey", "p_size", 10, 1), shape(zones, "s_suppkey", "s_nationkey", 20, 2), 50.0, shrink)


def _sql_series(c, xi, eta, sign):
    a = " ".join(f"{'+' if sign > 0 else '-'} {w!r} * sin({2 * k} * {xi}) * cosh({2 * k} * {eta})" for k, w in enumerate(c, 1))
    b = " ".join(f"{'+' if sign > 0 else '-'} {w!r} * cos({2 * k} * {xi}) * sinh({2 * k} * {eta})" for k, w in enumerate(c, 1))
    return f"{xi} {a}", f"{eta} {b}"


_XI, _ETA = _sql_series(FORTH, "xi", "eta", 1)


@query(f"""WITH p AS (SELECT c_custkey, 141 + (c_custkey % 6000) / 1000.0::DOUBLE AS lon, -28 - c_nationkey / 2.0::DOUBLE - (c_custkey % 97) / 1000.0::DOUBLE AS lat FROM customer),
           t AS (SELECT *, radians(lon - 147) AS lam, sin(radians(lat)) AS s FROM p), u AS (SELECT *, sinh(atanh(s) - sqrt(0.006694380022903416::DOUBLE) * atanh(sqrt(0.006694380022903416::DOUBLE) * s)) AS t FROM t),
           x AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM u)
           SELECT c_custkey, round(500000 + 0.9996 * 6367449.145771051::DOUBLE * ({_ETA}), 3) AS east, round(10000000 + 0.9996 * 6367449.145771051::DOUBLE * ({_XI}), 3) AS north, round(lon, 9) AS lon, round(lat, 9) AS lat FROM x""")
def zone_grid(spark, d):
    """Points in zone 55, and back from there."""
    k = F.col("c_custkey")
    at = table(spark, d, "customer").select("c_custkey", (141 + (k % 6000) / 1000.0).alias("lon"), (-28 - F.col("c_nationkey") / 2.0 - (k % 97) / 1000.0).alias("lat"))
    east, north = to_zone(F.col("lon"), F.col("lat"), 55)
    at = at.select("c_custkey", east.alias("east"), north.alias("north"))
    lon, lat = from_zone(F.col("east"), F.col("north"), 55)
    return at.select("c_custkey", F.round("east", 3).alias("east"), F.round("north", 3).alias("north"), F.round(lon, 9).alias("lon"), F.round(lat, 9).alias("lat"))
