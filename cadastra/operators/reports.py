"""Reports on properties: lookups, facts, assessments, pattern books, question cards and plans of a language model, all as columns and rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The facts of a property in order. `{column}` stands for a value, `{column|else}` for one that may be missing, `{column:1}` for a number with so
# many digits. A line goes where a value without an `else` is missing, or where the column before `?` isn't true.
FACTS = """
Address: {address}
Zone: {zone} ({zone_class|})
LEP: {lep_name|N/A}
LGA: {lga_name|N/A}
Council: {council_name|N/A}
FSR: {fsr_value}
Max height: {max_height_m}m
Min lot size: {min_lot_size} {lot_size_units|sqm}
Lot area: {area_sqm:0} sqm
Primary frontage: {primary_frontage_length_m}m ({primary_frontage_road|})
Min lot width: {min_width_m}m
Average slope: {average_slope:1}°
is_corner_lot?Corner lot: Yes
is_battleaxe?Battle-axe lot: Yes
Heritage: {heritage_name} ({heritage_class|})
Flood mapping: {floodmapping}
Bushfire prone: {bushfireproneland}
Biodiversity: {biodiversity}
Acid sulfate soils: {acid_sulfate}
Coastal wetlands: {coastal_wetlands}
Riparian/watercourse: {riparianlandwatercourse}
Contamination: {contamination_sitename}
cdc_eligible?CDC eligible: Yes ({total_cdc_eligible|0} pathways)
!cdc_eligible?CDC eligible: No
cdc_dwelling_houses?CDC dwelling houses: eligible
cdc_dual_occupancy?CDC dual occupancy: eligible
cdc_secondary_dwellings?CDC secondary dwellings: eligible
in_lmr_housing_area?In Low-Mid Rise housing area: Yes
DCP: {dcp_plan_name}
""".strip().splitlines()
# The columns of which each that is not empty is a constraint.
CONSTRAINED = [
    "heritage_name", "floodmapping", "bushfireproneland", "biodiversity", "acid_sulfate", "landsliderisk", "groundwatervulnerability", "coastal_wetlands", "coastal_environment_area", "coastal_use_area",
    "riparianlandwatercourse", "drinking_water_catchment", "scenicprotectionland", "mine_subsidence_district", "contamination_sitename",
]
# The designs of the pattern book; their columns end in `_eligible`.
PATTERNS = ["semis_01_anthony_gill", "semis_02_sibling", "manor_homes_01_studio", "row_homes_01_saha", "terraces_01_carter", "terraces_02_sam_crawford", "terraces_03_officer_woods", "terraces_04_other"]
# The cards of a report with the kind of document that answers them (none: any), and a question of our own for each.
CARDS = [
    ("clause_46", "lep", "Which standards of {lep} can be varied under clause 4.6 in {zone}, and by which tests?"),
    ("subdivision", "lep", "What does {lep} ask of a subdivision in {zone}: lot size, frontage, exceptions?"),
    ("secondary_dwelling", None, "When may a secondary dwelling be built in {zone}, and how large may it be?"),
    ("dual_occupancy", "lep", "What does {lep} ask of a dual occupancy in {zone}, attached or detached?"),
    ("setbacks_envelope", "dcp", "Which front, side and rear setbacks and height planes hold in {zone}?"),
    ("parking_access", "dcp", "Which parking rates and driveway rules hold in {zone}?"),
    ("heritage", "lep", "What does {lep} ask where heritage items or conservation areas are affected in {zone}?"),
    ("contributions", "lep", "Which contribution plans and levies apply to development in {zone}?"),
]
# The intents and document kinds of a plan.
INTENTS, KINDS = ["permissibility", "thresholds", "definition", "cross_doc", "general"], ["lep", "sepp", "dcp"]
#: Which steps a report takes for whom.
PERSONAS = {"owner": {"summary": False, "cards": 0}, "developer": {"summary": True, "cards": 0}, "planner": {"summary": True, "cards": len(CARDS)}}


def _given(df: DataFrame, name: str) -> Column:
    """A column as text, null where it is empty or not there."""
    return F.nullif(F.col(name).cast("string"), F.lit("")) if name in df.columns else F.lit(None).cast("string")


def _number(df: DataFrame, name: str) -> Column:
    """A column as a number above zero; 0 and what is no number say nothing."""
    return F.nullif(_given(df, name).try_cast("double"), F.lit(0.0))


def property_lookup(properties: DataFrame, address: str = "", lat: float | None = None, lon: float | None = None) -> DataFrame:
    """The property of an address, or, without one, the nearest to a point; ValueError where neither is given."""
    if address:
        rows = properties.filter(F.col("address") == address)
        # of several rows the first by their other columns, whatever order they come in
        return rows.orderBy(*[c for c, kind in rows.dtypes if not kind.startswith("map")]).limit(1)
    if lat is None or lon is None:
        raise ValueError("an address or a latitude and a longitude are required")
    at = F.pow(F.col("centroid_lat").cast("double") - lat, 2) + F.pow(F.col("centroid_lon").cast("double") - lon, 2)
    return properties.filter("centroid_lat is not null and centroid_lon is not null").withColumn("_d", at).orderBy("_d", "address").limit(1).drop("_d")


def fact_block(properties: DataFrame, key: str, facts: list[str] = FACTS) -> DataFrame:
    """(key, block): the lines of the facts that a property has; see FACTS for how a line is written."""
    true = lambda name: F.coalesce(_given(properties, name) == "true", F.lit(False))

    def value(slot: str) -> Column:
        name, has_else, other = slot.partition("|")
        name, has_digits, digits = name.partition(":")
        if has_digits:
            return F.when(_number(properties, name).isNotNull(), F.format_string(f"%.{digits}f", _number(properties, name)))
        return F.coalesce(_given(properties, name), F.lit(other)) if has_else else _given(properties, name)

    def line(fact: str) -> Column:
        when, _, said = fact.rpartition("?")
        pieces = re.split(r"\{([^}]*)\}", said)
        made = F.concat(*[value(x) if k % 2 else F.lit(x) for k, x in enumerate(pieces)])
        return made if not when else F.when(~true(when[1:]) if when[0] == "!" else true(when), made)

    return properties.select(key, F.concat_ws("\n", *map(line, facts)).alias("block"))


def assess(properties: DataFrame, key: list[str]) -> DataFrame:
    """(key, lot_band, frontage_band, gfa, storeys, n_constraints, pathway) of properties.

    lot_band: the lot against the least size: under it, at least twice it, or between. frontage_band: narrow below 12 m, wide from 15 m
    on. gfa: area times floor space ratio; storeys: of 3.1 m each. pathway: complying development is viable without constraints, to
    be verified with some, and otherwise an application is needed. What isn't known is null.
    """
    area, least, front = (_number(properties, c) for c in ("area_sqm", "min_lot_size", "frontage_m"))
    ratio = area / least
    n = reduce(lambda a, b: a + b, [_given(properties, c).isNotNull().cast("int") for c in CONSTRAINED])
    open_ = F.coalesce(_given(properties, "cdc_eligible") == "true", F.lit(False))
    return properties.select(
        *key,
        F.when(ratio < 1, "under").when(ratio >= 2, "exceeds").when(ratio.isNotNull(), "meets").alias("lot_band"),
        F.when(front < 12, "narrow").when(front >= 15, "wide").when(front.isNotNull(), "between").alias("frontage_band"),
        F.round(area * _number(properties, "fsr_value")).alias("gfa"), F.floor(_number(properties, "max_height_m") / 3.1).cast("double").alias("storeys"), n.alias("n_constraints"),
        F.when(open_ & (n == 0), "viable").when(open_, "verify").otherwise("application").alias("pathway"),
    )


def pattern_rows(properties: DataFrame, key: str) -> DataFrame:
    """(key, pattern, eligible): the pattern book's designs; those not eligible are shown in low and mid rise areas only."""
    in_area = F.coalesce(_given(properties, "in_lmr_housing_area") == "true", F.lit(False))
    rows = [F.struct(F.lit(p).alias("pattern"), F.coalesce(_given(properties, f"{p}_eligible") == "true", F.lit(False)).alias("eligible")) for p in PATTERNS]
    shown = F.filter(F.array(*rows), lambda x: x["eligible"] | in_area)
    return properties.select(key, F.explode(shown).alias("p")).select(key, "p.*")


def question_cards(properties: DataFrame, key: str, persona: str = "planner") -> DataFrame:
    """(key, card, doc_type, question): the cards that a persona gets, with the property's zone and plan in the question."""
    zone = F.coalesce(F.concat(F.lit("Zone "), _given(properties, "zone")), F.lit("the zone of the site"))
    lep = F.coalesce(_given(properties, "lep_name"), F.concat(_given(properties, "lga_name"), F.lit(" LEP")), F.lit("the local plan"))
    said = lambda q: F.replace(F.replace(F.lit(q), F.lit("{lep}"), lep), F.lit("{zone}"), zone)
    rows = [F.struct(F.lit(c).alias("card"), F.lit(d).cast("string").alias("doc_type"), said(q).alias("question")) for c, d, q in CARDS[: PERSONAS[persona]["cards"]]]
    if not rows:
        return properties.select(key, F.lit("").alias("card"), F.lit("").alias("doc_type"), F.lit("").alias("question")).limit(0)
    return properties.select(key, F.explode(F.array(*rows)).alias("c")).select(key, "c.*")


def answered(cards: DataFrame, call: Callable[[dict], str]) -> DataFrame:
    """cards with answer and error: an injected callable answers each; one that fails has its error and blocks none of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers, errors = [], []
            for row in b.to_pylist():
                try:
                    answers.append(call(row)), errors.append(None)
                except Exception as e:  # noqa: BLE001  whatever fails is the card's own
                    answers.append(None), errors.append(str(e)[:300])
            yield pa.record_batch([*b.columns, pa.array(answers, pa.string()), pa.array(errors, pa.string())], [*b.schema.names, "answer", "error"])

    return cards.mapInArrow(run, ", ".join([f"`{n}` {k}" for n, k in cards.dtypes] + ["answer string", "error string"]))


def valid_plan(text: Column, keywords: Column) -> Column:
    """struct(intent, zone, land_use, lga, doc_type, topic, keywords, surface_overrides) of a model's JSON; keywords: what stands in for its own.

    An unknown intent is `general`, an unknown kind of document none; keywords are trimmed texts, twelve at most; anything that is
    not of the right type says nothing. Text that is no JSON object gives a general plan with the keywords that stand in.
    """
    v = F.try_parse_json(text)
    at = lambda p: F.nullif(F.trim(F.when(F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "STRING", F.try_variant_get(v, p, "string"))), F.lit(""))
    one = lambda x: F.trim(F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    own = F.slice(F.filter(F.transform(F.try_variant_get(v, "$.keywords", "array<variant>"), one), lambda x: F.coalesce(x, F.lit("")) != ""), 1, 12)
    intent, kind = at("$.intent"), at("$.entities.doc_type")
    over = F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(v, "$.surface_overrides", "variant")) == "BOOLEAN", F.try_variant_get(v, "$.surface_overrides", "boolean")), F.lit(False))
    return F.struct(
        F.when(intent.isin(INTENTS), intent).otherwise("general").alias("intent"), *[at(f"$.entities.{k}").alias(k) for k in ("zone", "land_use", "lga")], F.when(kind.isin(KINDS), kind).alias("doc_type"), at("$.entities.topic").alias("topic"),
        F.coalesce(own, keywords).alias("keywords"), over.alias("surface_overrides"),
    )


def proposition_text(rows: DataFrame) -> Column:
    """What is embedded of a proposition: `document | council | section — [type] subject predicate object (comparator value unit) IF: ... REF: ...`."""
    g = lambda c: _given(rows, c)
    limit = F.concat(F.lit("("), F.concat_ws(" ", g("comparator"), g("value"), g("unit")), F.lit(")"))
    core = F.concat_ws(
        " ", F.concat(F.lit("["), g("type"), F.lit("]")), g("subject"), g("predicate"), g("object"), F.when(g("value").isNotNull(), limit),
        F.concat(F.lit("IF: "), g("condition_text")), F.concat(F.lit("REF: "), g("overrides_ref")),
    )
    where = F.concat_ws(" | ", g("document_title"), F.coalesce(g("lga_name"), F.when(g("scope") == "state", "State-wide")), g("section_heading"))
    return F.concat_ws(" — ", F.nullif(where, F.lit("")), core)


def render_citations(answer: Column, refs: Column) -> Column:
    """HTML of an answer: escaped, without a `Sources:` tail, each marker of refs (an array) as its number, others as they stand."""
    from cadastra.functions.text import html_escape

    text = html_escape(F.trim(F.regexp_replace(answer, r"(?is)\n+\s*\**sources:?\**\s*\n.*$", "")))
    numbered = F.transform(refs, lambda r, i: F.struct(r.alias("r"), (i + 1).cast("string").alias("n")))
    chip = lambda acc, x: F.replace(acc, F.concat(F.lit("["), x["r"], F.lit("]")), F.concat(F.lit('<sup data-ref="'), x["r"], F.lit('">'), x["n"], F.lit("</sup>")))
    return F.aggregate(numbered, text, chip)


def anchor_candidates(anchor: Column) -> Column:
    """The ids that an anchor may stand for in a document, in the order in which they are tried."""
    known = F.array_distinct(F.array(anchor, F.concat(F.lit("dcp."), anchor), F.concat(F.lit("dcp."), F.regexp_replace(anchor, r"^sec\.", ""))))
    return F.when(F.coalesce(anchor, F.lit("")) != "", F.transform(known, lambda x: F.replace(x, F.lit("#"), F.lit("_"))))
