"""Legal XML put together from the parts, a document a brand, and read again by the operators; SQL says from the parts what has to come out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadastra.operators import legal_xml as lx
from cadastra.plans.registry import query
from cadastra.sources.tables import table, written

# Fixed frame of a document; the lists come from its parts.
_HEAD = '<act id="lep-%s" title="%s Plan" year="2012"><metacontent class="council">%s Council</metacontent>'
_ZONES = """<level type="part" id="pt.2"><head><no>Part 2</no><heading>Zones</heading></head><level type="clausegroup" id="z1"><head><heading>Zone R2 Low Density</heading></head>
<tier id="u1"><head><heading>Permitted with consent</heading></head><block><txt>%s; Any other development not specified in item 2</txt></block></tier><tier id="u2"><head><heading>Prohibited</heading></head><block><txt>%s; Nil</txt></block></tier></level>
<level type="clausegroup" id="z2"><head><heading>Zone E1 Local Centre</heading></head><tier id="u3"><head><heading>Permitted without consent</heading></head><block><txt>Nil</txt></block></tier></level></level>"""
_CLAUSE = """<level type="clause" id="sec.4.%d"><head><no>4.%d</no><heading>%s</heading></head><block><txt>Land%s of not less than %d00 square metres, see clause 5.%d.</txt></block>
<tier id="sec.4.%d-ssec.1"><head><no>(1)</no></head><block><txt>A %s of %d.5 metres.</txt></block></tier></level>"""
_MINOR = '<tier id="sec.3.1-ssec.%d"><head><no>(%d)</no></head><block><txt>Must be %s</txt></block></tier>'
_CONTROL = '<tier id="sec.5.4-ssec.%d"><head><no>(%d)</no><heading>%s</heading></head><block><txt>no more than %d bedrooms in Zone R2</txt></block></tier>'
_LOCAL = '<level type="clause" id="sec.6.%d"><head><no>6.%d</no><heading>%s</heading></head><tier id="sec.6.%d-ssec.2"><head><no>(2)</no></head><block><txt>Consent is needed for %s.</txt></block></tier></level>'
_EXEMPT = '<level type="clause" id="sch.2-sec.%d"><head><heading>%s</heading></head><tier id="sch.2-sec.%d-ssec.1"><block><txt>Small %s in Zone E1</txt></block></tier></level>'
_TERM = '<defterm type="definition">%s</defterm><table><row><entry>Town</entry><entry>%s</entry><entry>%d High St</entry><entry>Lot %d</entry><entry>Local</entry><entry>I%d</entry></row></table>'
_ELEMENTS: dict = {}


def _documents(spark, d):
    """The documents in pieces (path, place, k, xml): a few for the frame, six for each part, and one for each use and type; in order of place, k and xml they are the document of a brand."""
    k, name, size, say = F.col("p_partkey"), F.col("p_name"), F.col("p_size"), F.format_string
    where = F.when(k % 3 == 0, " in Zone R2").when(k % 3 == 1, " in Zone E1").otherwise("")
    part = table(spark, d, "part")
    made = [say(_MINOR, k, k, name), say(_CLAUSE, k, k, name, where, size, k, k, name, size), say(_CONTROL, k, k, name, size), say(_LOCAL, k, k, F.col("p_type"), k, name), say(_EXEMPT, k, name, k, name), say(_TERM, name, name, k, k, k)]
    piece = lambda place, k, xml: F.struct(F.lit(place).alias("place"), k.cast("long").alias("k"), xml.alias("xml"))
    b, none = F.col("p_brand"), F.lit(None)
    uses, types = _ZONES.split("%s; ")[1:]
    frame = {
        0: F.concat(say(_HEAD, b, b, b), F.lit(_ZONES.split("%s; ")[0])), 2: F.lit(uses), 4: F.concat(F.lit(types), F.lit('<level type="clause" id="sec.3.1"><head><no>3.1</no><heading>Exempt</heading></head>')),
        6: F.lit('</level><level type="part" id="pt.4"><head><no>Part 4</no><heading>Standards</heading></head>'), 8: F.lit('</level><level type="clause" id="sec.5.4"><head><no>5.4</no><heading>Controls</heading></head>'),
        10: F.lit('</level><level type="part" id="pt.6"><head><no>Part 6</no><heading>Local</heading></head>'), 12: F.lit('</level><level type="schedule" id="sch.2">'), 14: F.lit('</level><level type="schedule" id="dict">'), 16: F.lit("</level></act>"),
    }
    of = lambda rows, pieces: rows.select(b.alias("path"), F.explode(F.array(*pieces)).alias("p")).select("path", "p.*")
    fixed = of(part.select("p_brand").distinct(), [piece(place, none, xml) for place, xml in frame.items()])
    listed = [of(part.select("p_brand", c).distinct(), [piece(place, none, F.concat(c, F.lit("; ")))]) for place, c in ((1, "p_name"), (3, "p_type"))]
    lists = of(part, [piece(5 + 2 * i, k, F.concat(xml, F.lit("\n"))) for i, xml in enumerate(made)])
    return reduce(DataFrame.unionByName, [fixed, *listed, lists])


def _elements(spark, d):
    """The elements of all documents, read once in a session."""
    at = spark.sparkContext.applicationId, d
    if at not in _ELEMENTS:
        _ELEMENTS[at] = written(lx.elements_of_pieces(_documents(spark, d), ["place", "k", "xml"]), "elements")
    return _ELEMENTS[at]


_P = "p AS (SELECT p_brand AS path, p_partkey AS k, p_name, p_type, p_size FROM part)"
_SLUG = "regexp_replace(regexp_replace(lower({x}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_NAMED = "CASE k % 3 WHEN 0 THEN ['R2'] WHEN 1 THEN ['E1'] ELSE ['E1', 'R2'] END"


@query(f"WITH {_P} SELECT DISTINCT path, 'lep-' || path AS id, path || ' Plan' AS title, '2012' AS year, path || ' Council' AS council FROM p")
def xml_plan_info(spark, d):
    return lx.plan_info(_elements(spark, d))


@query(f"""WITH {_P} SELECT path, 'sec.4.' || k AS id, '4.' || k AS number, p_name AS title, 4 AS part FROM p UNION ALL SELECT DISTINCT path, unnest(['pt.2', 'pt.4', 'pt.6', 'sec.5.4']), unnest(['Part 2', 'Part 4', 'Part 6', '5.4']),
           unnest(['Zones', 'Standards', 'Local', 'Controls']), unnest([2, 4, 6, 5]) FROM p""")
def xml_sections(spark, d):
    return lx.sections(_elements(spark, d))


@query(f"WITH {_P} SELECT DISTINCT path, unnest(['R2', 'E1']) AS code, unnest(['Low Density', 'Local Centre']) AS title, unnest(['R', 'E']) AS family FROM p")
def xml_zones(spark, d):
    return lx.zones(_elements(spark, d)).select("path", "code", "title", "family")


@query(f"""WITH {_P}, u AS (SELECT DISTINCT path, 'with' AS consent, p_name AS use FROM p UNION ALL SELECT DISTINCT path, 'prohibited', p_type FROM p UNION ALL SELECT DISTINCT path, 'with', 'Any other development not specified in item 2' FROM p)
           SELECT path, 'R2' AS code, consent, use, {_SLUG.format(x="use")} AS slug, use LIKE 'Any other%' AS catch_all FROM u""")
def xml_land_uses(spark, d):
    return lx.land_uses(_elements(spark, d)).drop("pos")


@query(f"WITH {_P}, u AS (SELECT path, p_name AS use FROM p UNION SELECT path, p_type FROM p) SELECT path, {_SLUG.format(x='use')} AS slug, lower(use) AS term FROM u WHERE length(use) > 3")
def xml_zoned_terms(spark, d):
    return lx.zoned_terms(_elements(spark, d))


@query(f"WITH {_P} SELECT DISTINCT path, p_name AS term, {_SLUG.format(x='p_name')} AS slug FROM p")
def xml_definitions(spark, d):
    return lx.definitions(_elements(spark, d))


@query(f"""WITH {_P} SELECT path, '4.' || k AS section, p_name AS heading, p_size * 100.0 AS value, 'sqm' AS unit, 'min' AS qualifier, '5.' || k AS refs FROM p
           UNION ALL SELECT path, '6.' || k, p_type, NULL, NULL, NULL, '' FROM p UNION ALL SELECT DISTINCT path, '5.4', 'Controls', NULL::DOUBLE, NULL, NULL, '' FROM p""")
def xml_requirements(spark, d):
    return lx.requirements(_elements(spark, d)).withColumn("refs", F.array_join("refs", ","))


@query(f"""WITH {_P} SELECT path, '4.' || k AS section, p_name AS heading, k % 3 = 2 AS applies_to_all_zones, unnest({_NAMED}) AS zone_code, p_size * 100.0 AS sqm, p_size + 0.5 AS m FROM p
           UNION ALL SELECT path, '6.' || k, p_type, true, unnest(['E1', 'R2']), NULL, NULL FROM p UNION ALL SELECT DISTINCT path, '5.4', 'Controls', false, 'R2', NULL::DOUBLE, NULL::DOUBLE FROM p""")
def xml_zone_index(spark, d):
    first = lambda c: F.try_element_at(c, F.lit(1))
    return lx.zone_index(_elements(spark, d)).select("path", "section", "heading", "applies_to_all_zones", "zone_code", first("sqm_values").alias("sqm"), first("m_values").alias("m"))


@query(f"""WITH {_P} SELECT path, '4.' || k AS section, p_name AS heading, CASE k % 3 WHEN 0 THEN 'R2' WHEN 1 THEN 'E1' ELSE '' END AS zones, (p_size * 100)::DOUBLE::VARCHAR AS sqm, '(1) A ' || p_name || ' of ' || p_size || '.5 metres.' AS said, false AS has_map_reference FROM p""")
def xml_lot_sizes(spark, d):
    said = F.array_join(F.transform("subclauses", lambda x: F.concat_ws(" ", x["number"], x["text"])), "|")
    rows = lx.lot_size_index(_elements(spark, d))
    return rows.select("path", "section", "heading", F.array_join("zones_referenced", ",").alias("zones"), F.array_join(F.transform("sqm", lambda x: x.cast("string")), ",").alias("sqm"), said.alias("said"), "has_map_reference")


@query(f"""WITH {_P}, n AS (SELECT path, count(*) AS n FROM p GROUP BY path) SELECT path, unnest(['act', 'level', 'tier', 'defterm']) AS tag, unnest([1, 9 + 3 * n, 3 + 5 * n, n]) AS n FROM n""")
def xml_structure(spark, d):
    """Nodes by kind: nine levels that each document has, and three, five tiers and a term for each part."""
    return lx.structure(_elements(spark, d))[0].groupBy("path", "tag").agg(F.count("*").alias("n"))


@query(f"WITH {_P} SELECT path, 'Town' AS suburb, p_name AS item_name, k || ' High St' AS address, 'Lot ' || k AS property_description, 'Local' AS significance, 'I' || k AS item_no FROM p")
def xml_heritage(spark, d):
    return lx.heritage_items(_elements(spark, d)).drop("pos")


@query(f"""WITH {_P} SELECT path, 'req:sec.5.4-ssec.' || k AS id, '5.4(' || k || ')' AS clause_id, {_SLUG.format(x="p_name")} AS use_slug, 'no more than ' || p_size || ' bedrooms in Zone R2' AS description, p_size::DOUBLE AS value, 'bedrooms' AS unit, 'max' AS qualifier, 'R2' AS zones FROM p""")
def xml_controls(spark, d):
    return lx.controls(_elements(spark, d)).withColumn("zones", F.array_join("zones", ","))


_TREE = f"""{_P}, t AS (SELECT path, k, 'req:sec.4.' || k AS id, NULL AS parent_id, '4.' || k AS clause_id, NULL::DOUBLE AS value, 'map-reference' AS unit, NULL AS qualifier FROM p
           UNION ALL SELECT path, k, 'req:sec.4.' || k || '-ssec.1', 'req:sec.4.' || k, '4.' || k || '(1)', p_size + 0.5, 'm', 'min' FROM p)"""


@query(f"WITH {_TREE} SELECT path, id, parent_id, clause_id, value, unit, qualifier FROM t")
def xml_requirement_tree(spark, d):
    return lx.requirement_tree(_elements(spark, d)).select("path", "id", "parent_id", "clause_id", "value", "unit", "qualifier")


@query(f"WITH {_TREE} SELECT path, id, unnest({_NAMED}) AS zone FROM t")
def xml_requirement_zones(spark, d):
    e = _elements(spark, d)
    return lx.requirement_zones(lx.requirement_tree(e), e)


@query(f"WITH {_P} SELECT path, 'exempt' AS kind, 'Must be ' || p_name AS text FROM p")
def xml_prerequisites(spark, d):
    return lx.prerequisites(_elements(spark, d)).select("path", "kind", "text")


@query(f"WITH {_P} SELECT path, p_name AS heading, 'exempt' AS consent, 'E1' AS zones, 'Small ' || p_name || ' in Zone E1' AS conditions FROM p")
def xml_schedule_items(spark, d):
    return lx.schedule_items(_elements(spark, d)).select("path", "heading", "consent", F.array_join("zones", ",").alias("zones"), F.array_join("conditions", "|").alias("conditions"))


@query(f"WITH {_P} SELECT path, '6.' || k AS number, p_type AS title, '(2)Consent is needed for ' || p_name || '.' AS summary FROM p")
def xml_local_provisions(spark, d):
    return lx.local_provisions(_elements(spark, d)).select("path", "number", "title", "summary")
