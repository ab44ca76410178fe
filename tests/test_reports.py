"""Reports on properties: lookups, facts, assessments, cards, plans and citations."""

import json

import pytest
from pyspark.sql import functions as F

from cadastra.operators import reports as rp
from cadastra.plans.property import title_search
from cadastra.streaming import events as ev


def test_lookup(spark):
    rows = spark.createDataFrame([("1 A St", 1.0, 1.0), ("2 B St", 5.0, 5.0), ("3 C St", None, 5.0)], "address string, centroid_lat double, centroid_lon double")
    assert rp.property_lookup(rows, "2 B St").first()["address"] == "2 B St" and rp.property_lookup(rows, lat=0, lon=0).first()["address"] == "1 A St"
    with pytest.raises(ValueError):
        rp.property_lookup(rows, lat=3.0)
    assert title_search(rows, "  ", "address").count() == 3 and title_search(rows, "b st", "address").count() == 1


def test_assessment(spark):
    rows = [("a", "900", "450", "20", "0.5", "9.5", "", None, "true"), ("b", "400", "450", "11.5", None, "0", "Yes", "x", "true"), ("c", None, "450", "13", "1", None, None, None, "false"), ("d", "600", "450", None, "x", "3", "", "", None)]
    df = spark.createDataFrame(rows, "k string, area_sqm string, min_lot_size string, frontage_m string, fsr_value string, max_height_m string, floodmapping string, heritage_name string, cdc_eligible string")
    got = {r["k"]: tuple(r)[1:] for r in rp.assess(df, ["k"]).collect()}
    assert got == {"a": ("exceeds", "wide", 450.0, 3.0, 0, "viable"), "b": ("under", "narrow", None, None, 2, "verify"), "c": (None, "between", None, None, 0, "application"), "d": ("meets", None, None, 0.0, 0, "application")}
    facts = {r["k"]: r["block"] for r in rp.fact_block(df, "k").collect()}
    none = "LEP: N/A\nLGA: N/A\nCouncil: N/A\n"
    assert facts["b"] == f"{none}Max height: 0m\nMin lot size: 450 sqm\nLot area: 400 sqm\nHeritage: x ()\nFlood mapping: Yes\nCDC eligible: Yes (0 pathways)"
    assert facts["c"] == f"{none}FSR: 1\nMin lot size: 450 sqm\nCDC eligible: No"


def test_cards(spark):
    df = spark.createDataFrame([(1, "R2", None, "Test"), (2, None, "Plan 2010", None)], "k int, zone string, lep_name string, lga_name string")
    cards = rp.question_cards(df, "k")
    assert cards.count() == 16 and rp.question_cards(df, "k", "owner").count() == 0
    said = {(r["k"], r["card"]): r["question"] for r in cards.collect()}
    assert "Test LEP" in said[1, "clause_46"] and "Zone R2" in said[1, "clause_46"] and "Plan 2010" in said[2, "heritage"] and "{" not in "".join(said.values())

    def call(row):
        if row["card"] == "heritage":
            raise ValueError("down")
        return row["question"].upper()

    got = rp.answered(cards, call).collect()
    assert len(got) == 16 and {r["card"] for r in got if r["error"] == "down"} == {"heritage"} and all((r["answer"] is None) == (r["error"] is not None) for r in got)


def test_plans(spark):
    plans = [
        {"intent": "thresholds", "entities": {"zone": " R2 ", "doc_type": "lep", "lga": 5}, "keywords": [" a ", "", 3, "b"] + ["k"] * 20, "surface_overrides": True},
        {"intent": "other", "entities": {"doc_type": "act"}, "keywords": "none", "surface_overrides": "true"},
        [],
    ]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(plans)] + [(3, "no json"), (4, None)], "i int, t string")
    got = [r["p"] for r in df.select("i", rp.valid_plan(F.col("t"), F.array(F.lit("fall"))).alias("p")).orderBy("i").collect()]
    assert (got[0]["intent"], got[0]["zone"], got[0]["lga"], got[0]["doc_type"], got[0]["surface_overrides"]) == ("thresholds", "R2", None, "lep", True)
    assert got[0]["keywords"] == ["a", "b"] + ["k"] * 10
    for p in got[1:]:
        assert (p["intent"], p["doc_type"], p["keywords"], p["surface_overrides"]) == ("general", None, ["fall"], False)


def test_texts(spark):
    df = spark.createDataFrame([("t", "lot", "has", "area", "<=", "5", "m", "Plan", None, "state", "if x", None), ("t", "lot", "has", "area", None, None, None, None, "City", None, None, "cl 1")], "type string, subject string, predicate string, object string, comparator string, value string, unit string, document_title string, lga_name string, scope string, condition_text string, overrides_ref string")
    assert [r[0] for r in df.select(rp.proposition_text(df)).collect()] == ["Plan | State-wide — [t] lot has area (<= 5 m) IF: if x", "City — [t] lot has area REF: cl 1"]
    text = "See [sec.1] & [dcp.2], <b> [sec.1] [sec.9].\n\n**Sources:**\n- x"
    got = spark.createDataFrame([(text, ["sec.1", "dcp.2"])], "a string, r array<string>").select(rp.render_citations(F.col("a"), F.col("r"))).first()[0]
    assert got == 'See <sup data-ref="sec.1">1</sup> &amp; <sup data-ref="dcp.2">2</sup>, &lt;b&gt; <sup data-ref="sec.1">1</sup> [sec.9].'
    anchors = spark.createDataFrame([("sec.4#2",), ("dcp.1",), ("",)], "a string").select(rp.anchor_candidates(F.col("a"))).collect()
    assert [r[0] for r in anchors] == [["sec.4_2", "dcp.sec.4_2", "dcp.4_2"], ["dcp.1", "dcp.dcp.1"], None]


def test_token_stream(spark):
    one = lambda t: "data: " + json.dumps({"choices": [{"delta": {"content": t}}]}) + "\n\n"
    whole = one("Hel") + ": note\n" + one("lo") + "data: {broken\n" + one("") + "data: [DONE]\n" + "data: {\"choices\": [{\"delta\": {\"content\": \"open"
    for size in (1, 7, 50):
        chunks = spark.createDataFrame([("r", k, whole[k : k + size]) for k in range(0, len(whole), size)], "run_id string, seq long, chunk string")
        assert [tuple(r) for r in ev.token_text(chunks).collect()] == [("r", "Hello")]
    rows = spark.createDataFrame([("done",), ("noise",)], "event string")
    assert [r[0] for r in ev.known_events(rows).collect()] == ["done"]
