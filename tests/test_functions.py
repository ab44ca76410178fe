"""Column functions and operators on the surveyed golden pairs and edge cases."""

import itertools
import json
import math
import struct
import uuid

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cadastra.functions import text as tx
from cadastra.operators import retrieval as rt
from cadastra.operators import spatial as sp
from cadastra.sources import tables as tb
from cadastra.plans.property import address_search, constraint_rows, pathway_rows, permissibility
from cadastra.streaming import events as ev


def values(spark, f, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_names(spark):
    assert values(spark, tx.lga_normalise, ["ALBURY CITY", "CITY OF PARRAMATTA", "GEORGES RIVER", "RANDWICK", None]) == ["albury", "parramatta", "georges river", "randwick", None]
    assert values(spark, tx.slug, ["Dual occupancies (attached)", "--A--"]) == ["dual-occupancies-attached", "a"]
    assert values(spark, tx.zone_family, ["RU1", "R2", "RE1", "E4", "X"]) == ["RU", "R", "RE", "E", "OTHER"]


def test_section_labels(spark):
    pairs = {
        "sec.4.3-ssec.2": "cl 4.3(2)", "sec.2.16-ssec.3-para1.a": "cl 2.16(3)(a)", "sch.4A-sec.15-ssec.1": "Sch 4A cl 15(1)", "pt.4": "Part 4", "ch.5-pt.2": "Ch 5 Pt 2", "ch.5-pt.2-sec.13": "Ch 5 Pt 2 cl 13",
        "dict": "Dictionary", "dcp.10.4.2": "s 10.4.2", "dcp.h4.5890.controls": "controls (DCP)", "sch.5": "Sch 5", "": "", "odd": "odd", "dcp.h2": "s h2",
    }
    assert values(spark, tx.section_label, list(pairs)) == list(pairs.values())


def test_document_labels(spark):
    rows = [("Albury Local Environmental Plan 2010", "lep", "Albury LEP"), ("Kiama Local Environmental Plan 2011", "lep", "Kiama LEP"), ("State Policy (Housing) 2021", "sepp", "Housing SEPP"), ("Policy (New) 2", "sepp", "New SEPP"), ("Policy", "sepp", "SEPP"), ("X Development Control Plan 2", "dcp", "X DCP"), ("Y", None, "Y"), (None, "lep", "")]
    df = spark.createDataFrame(rows, "t string, k string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", tx.document_label(F.col("t"), F.col("k"))).collect())


def test_metrics(spark):
    got = values(spark, tx.metric, ["not less than 1,200 square metres", "8.5 metres", "must not exceed 8.5 metres", "25 per cent", "none"])
    assert [(r["value"], r["unit"], r["qualifier"]) for r in got] == [(1200.0, "sqm", "min"), (8.5, "m", "min"), (8.5, "m", "max"), (25.0, "%", "max"), (None, None, None)]


def test_routes(spark):
    df = spark.createDataFrame([("as you said above", "x", "context_only"), ("as you said above", "", "new_lookup"), ("What is CDC?", None, "context_only"), ("Is a duplex permitted", None, "use_check"), ("rear boundary", None, "dcp_controls"), ("about the codes SEPP", None, "cdc_sepp")], "q string, p string, want string")
    assert all(r["got"] == r["want"] for r in df.withColumn("got", tx.route(F.col("q"), F.col("p"))).collect())


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="ascii"), max_size=40), min_size=1, max_size=5))
def test_normalising_twice_changes_nothing(spark, inputs):
    for f in (tx.subject_normalise, tx.slug):
        once = values(spark, f, inputs)
        assert values(spark, f, once) == once


def test_rolling_hash(spark):
    def h(s):
        x = 0
        for c in s:
            x = (x * 31 + ord(c)) & 0xFFFFFFFF
        return x - (1 << 32) if x >= 1 << 31 else x

    words = ["", "a", "zoning", "é" * 30]
    assert values(spark, tx.rolling_hash, words) == [h(w) for w in words]


def greedy(spark, levels, pairs=None):
    rows = [(1, i, i, d, lv, "rule", s) for i, (d, lv, s) in enumerate(levels)]
    df = spark.createDataFrame(rows, "query_id int, pos int, id int, document_id string, level int, type string, subject string")
    return [r["kept"] for r in rt.precedence_greedy(df).orderBy("pos").collect()]


def test_precedence_order_matters(spark):
    s, l, d = ("S", 2, "floor space"), ("L", 3, "floor space ratio"), ("D", 4, "space ratio")
    assert greedy(spark, [s, l, d]) == [True, False, True]
    assert greedy(spark, [l, d, s]) == [False, False, True]
    assert greedy(spark, [("A", 3, "height"), ("B", 3, "height")]) == [True, True]


def test_fusion_prefers_the_vector_list(spark):
    v = spark.createDataFrame([(1, 1), (2, 2)], "id long, vector_rank int")
    t = spark.createDataFrame([(3, 1), (2, 2)], "id long, text_rank int")
    assert [r["id"] for r in rt.fuse(v, t).collect()] == [2, 1, 3]


def test_expand(spark):
    node = lambda x: (None, None) if x is None else (x[0], int(x[1:]))
    kinds = [("defines", "d1", "s0"), ("requires", "s0", "r1"), ("requires", "s0", None), ("constrains", "c1", "s0"), ("constrains", "d1", "s0"), ("defines", "s0", "s0"), ("requires", "x0", "r9")]
    edges = spark.createDataFrame([(t, *node(a), *node(b)) for t, a, b in kinds], "type string, from_kind string, from_key long, to_kind string, to_key long")
    seeds = spark.createDataFrame([("s", 0)], "kind string, key long")
    assert [(r["id"], r["expanded_via"]) for r in rt.expand(seeds, edges).orderBy("pos").collect()] == [("d1", "defines"), ("r1", "requires"), ("c1", "constrains")]
    assert rt.expand(seeds, edges, 2).count() == 2


def test_autocomplete(spark):
    rows = [("1/500 DEAN STREET ALBURY", 1), ("500 DEAN STREET ALBURY", 2), ("502 DEAN STREET ALBURY", 3), ("9 SMITH ROAD SYDNEY", 4), ("500 DEAN STREET ALBURY", 5)]
    df = spark.createDataFrame(rows, "address string, id int")
    for asked in ("1/500 Dean Street Albury", "500 Dean Street Albury"):
        assert [(r["id"], r["_exact"], r["_dist"]) for r in address_search(df, asked).collect()] == [(1, 0, 0), (2, 0, 0), (3, 1, 2)]
    assert address_search(df, "50").count() == 0
    assert [r["id"] for r in address_search(df, "smith").collect()] == [4]
    assert address_search(df, "de%n").count() == 0


def test_permissibility(spark):
    uses = spark.createDataFrame([("R2", "Dwelling houses"), ("R2", "Dual occupancies"), ("B1", "Shops")], "zone string, use string")
    got = {r["zone"]: (r["status"], r["matched"]) for r in permissibility(uses, "dual occupancy").collect()}
    assert got == {"R2": ("permitted", "Dual occupancies"), "B1": ("not_found", None)}


def test_unpivots(spark):
    df = spark.createDataFrame([(1, "No", "Yes", None, "true", "x"), (2, None, None, "Class 5", "false", None)], "id int, floodmapping string, bushfireproneland string, acid_sulfate string, cdc_general string, cdc_general_exclusions string")
    assert sorted((r["id"], r["label"], r["severity"]) for r in constraint_rows(df, "id").collect()) == [(1, "Bushfire: Yes", "high"), (2, "Acid sulfate soils: Class 5", "low")]
    assert [(r["id"], r["eligible"]) for r in pathway_rows(df, "id").orderBy("id").collect()] == [(1, True), (2, False)]


SQUARE = [[(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0), (0.0, 0.0)]]


def test_geometry():
    g = sp.write_wkb("Polygon", SQUARE)
    assert sp.read_wkb(g) == ("Polygon", SQUARE) and sp.wkt(g) == "POLYGON ((0 0, 2 0, 2 2, 0 2, 0 0))"
    assert sp.centroid(g) == pytest.approx((1, 1))
    assert sp.wkt(struct.pack("<BIId", 1, 0x20000001, 4283, 1.5) + struct.pack("<d", 2)) == "POINT (1.5 2)"
    move = lambda dx: sp.write_wkb("MultiPolygon", [[[(x + dx, y) for x, y in SQUARE[0]]]])
    assert sp.wkt(sp.from_wkt("SRID=4283;MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0), (0.2 0.1, 0.4 0.1, 0.4 0.2, 0.2 0.1)))")) == "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0), (0.2 0.1, 0.4 0.1, 0.4 0.2, 0.2 0.1)))"
    assert sp.intersects(g, move(1)) and not sp.intersects(g, move(5)) and sp.intersects(g, sp.write_wkb("Polygon", [[(x / 4 + 0.5, y / 4 + 0.5) for x, y in SQUARE[0]]]))
    # Flinders Peak to Buninyong, a published test of the inverse formula: 54,972.271 m
    assert sp.geodesic_metres(-37.951033417, 144.424867889, -37.652821139, 143.926495528) == pytest.approx(54972.271, abs=0.05)
    assert sp.geodesic_metres(1, 1, 1, 1) == 0


def turned(start, dx=0.0, dy=0.0, back=False):
    """A unit square whose ring starts at any of its corners and runs either way."""
    r = [(x + dx, y + dy) for x, y in [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]
    r = r[start:] + r[:start]
    r = r[::-1] if back else r
    return sp.write_wkb("Polygon", [[*r, r[0]]])


def test_touching_shapes_meet():
    for s1, s2, back in itertools.product(range(4), range(4), (False, True)):
        for dx, dy in itertools.product((0, 0.5, 1, 1.5), repeat=2):
            assert sp.intersects(turned(s1), turned(s2, dx, dy, back)) == (dx <= 1 and dy <= 1)
            # drawn in, squares that only touch don't meet
            assert sp.intersects(sp.inset(turned(s1, back=back), 0.1), turned(s2, dx, dy)) == (dx < 1 and dy < 1)
    hole = sp.write_wkb("Polygon", [[(-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5)], [(-2, -2), (3, -2), (3, 3), (-2, 3), (-2, -2)]])
    assert not sp.intersects(turned(0), hole) and sp.intersects(turned(0, 2.0), hole)
    point = lambda x, y: sp.write_wkb("Point", [(x, y)])
    assert [sp.intersects(point(*p), turned(2)) for p in [(0.5, 0.5), (1, 0.5), (1, 1), (1.1, 0.5)]] == [True, True, True, False]
    pair = sp.write_wkb("MultiPolygon", [[[(9, 9), (10, 9), (10, 10), (9, 9)]], [[(0.4, 0.4), (0.5, 0.4), (0.5, 0.5), (0.4, 0.4)]]])
    assert sp.intersects(pair, turned(1)) and sp.intersects(turned(3), pair)


def test_inset():
    assert sp.inset(turned(0), 0.6) is None
    bent = sp.polygons(sp.inset(sp.from_wkt("POLYGON ((0 0, 2 0, 2 1, 1 1, 1 2, 0 2, 0 0))"), 0.1))[0][0]
    assert bent == pytest.approx(np.array([(0.1, 0.1), (1.9, 0.1), (1.9, 0.9), (1, 0.9), (0.9, 1), (0.9, 1.9), (0.1, 1.9), (0.1, 0.1)]), abs=1e-9)
    circle = [(math.cos(k / 50 * math.pi), math.sin(k / 50 * math.pi)) for k in range(100)]
    outer, hole = sp.polygons(sp.inset(sp.write_wkb("Polygon", [[*circle, circle[0]], [(-0.1, -0.1), (0.1, -0.1), (0.1, 0.1), (-0.1, 0.1), (-0.1, -0.1)]]), 0.2))[0]
    assert sp.area(outer) == pytest.approx(math.pi * 0.64, rel=0.01) and abs(sp.area(hole)) == pytest.approx(0.28, abs=0.01)
    # a slanted neighbour that only touches is left out, one that laps over by more is not
    slant = lambda by: sp.write_wkb("Polygon", [[(2 - by, 0), (3, 0), (3, 2), (0 - by, 2), (2 - by, 0)]])
    lot = sp.inset(sp.write_wkb("Polygon", [[(0, 0), (2, 0), (0, 2), (0, 0)]]), 0.01)
    assert not sp.intersects(lot, slant(0.0)) and sp.intersects(lot, slant(0.1))


def test_nearest_metres(spark):
    points = spark.createDataFrame([(1, 144.424867889, -37.951033417)], "id int, x double, y double")
    places = spark.createDataFrame([(7, 143.926495528, -37.652821139, "a"), (8, 120.0, -20.0, "a"), (9, 144.424867889, -37.951033417, "b")], "place_id int, x double, y double, g string")
    got = {r["g"]: (r["place_id"], r["metres"]) for r in sp.nearest_metres(points, places, "g").collect()}
    assert got == {"a": (7, 54972.0), "b": (9, 0.0)}


def test_batch_search_in_blocks(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 5))
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(400, None)], "id long, embedding array<double>")
    asked = rows.filter("id % 7 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("vector"))
    got = {(r["query_id"], r["rank"]): r["id"] for r in rt.batch_vector_search(rows, asked, 4, most=10).collect()}
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(0, 300, 7):
        d = np.round(1 - unit @ unit[i], 6)
        assert [got[i, k + 1] for k in range(4)] == np.lexsort((np.arange(300), d))[:4].tolist()
    assert len(got) == 43 * 4 and rt.batch_vector_search(rows, asked.limit(0), 4).count() == 0


def test_precedence_pairs_name_the_lowest(spark):
    rows = [(1, "A", 1, "t", "x"), (2, "A", 3, "t", "X!"), (3, "B", 2, "t", "x"), (4, "C", 2, "t", "x "), (5, "D", 1, "t", "y"), (6, "E", 4, "t", ""), (7, "F", 1, "t", "")]
    got = {r["loser_id"]: r["winner_id"] for r in rt.precedence_pairs(spark.createDataFrame(rows, "id int, document_id string, level int, type string, subject string")).collect()}
    assert got == {2: 3, 3: 1, 4: 1}


def test_plural_hit(spark):
    cases = [("pony", "two ponies"), ("ponies", "a pony"), ("houses", "a house"), ("gas", "ga"), ("shop", "shops"), ("dairies", "dairy (restricted)"), ("farms", "arms")]
    df = spark.createDataFrame(cases, "term string, text string")
    assert [r[0] for r in df.select(tx.plural_hit(F.col("term"), F.col("text"))).collect()] == [True, True, True, False, True, True, False]


def test_bold_numbers(spark):
    texts = ["at least 1,200 m2 in 2015", "clause 4.3 allows 8.5 m", "FSR 0.5:1", "section 12 metres of", "in 1999 and 25% of 3 storeys", "Zone R2 has 2000 sqm"]
    want = ["at least **1,200 m2** in 2015", "clause 4.3 allows **8.5 m**", "FSR **0.5:1**", "section 12 metres of", "in 1999 and **25%** of **3 storeys**", "Zone R2 has **2000 sqm**"]
    texts += ["28 days, 5 km and 12 dwellings", "Division 3 metres, Chapter 5 m, item 2 rooms", "2010 years, 10 years", "1 metre or 1 square metre", "5 mph 60 km/h", "3 memories", "", "a < 5 m > b"]
    want += ["**28 days**, **5 km** and **12 dwellings**", "Division 3 metres, Chapter 5 m, item 2 rooms", "2010 years, **10 years**", "**1 metre** or **1 square metre**", "**5 mph** **60 km/h**", "3 memories", "", "a < 5 m > b"]
    texts += ['<b title="5 m">5 m</b> <strong>6 m <i>7 m</i></strong> 8 m', '9 m<a class="cite-num" href="x">10 m</a> 11 m', None]
    want += ['<b title="5 m">**5 m**</b> <strong>6 m <i>7 m</i></strong> **8 m**', '**9 m**<a class="cite-num" href="x">10 m</a> **11 m**', None]
    assert values(spark, tx.bold_numbers, texts) == want
    assert values(spark, lambda c: tx.bold_numbers(c, ("<strong>", "</strong>")), ["is 5 m high"]) == ["is <strong>5 m</strong> high"]


def test_markdown(spark):
    text = "intro <x> & **bold** `a*b`\n\n### small ###\n# Big\n\n\n- one\n* two\n-not\n\nend\n\nSources: [1]\nmore"
    want = '<p>intro &lt;x&gt; &amp; <strong>bold</strong> <code>a*b</code>\n<div class="heading-small">small ###</div>\n<div class="heading">Big</div>\n<ul><li>one</li></ul>\n<ul><li>two</li></ul>\n-not</p><p>end</p>'
    got = values(spark, tx.markdown_html, [text, "", None, "x"])
    assert got[1:] == ["", "", "<p>x</p>"] and got[0].replace("\n", "") == want.replace("\n", "")


def test_tables_and_documents(spark, tmp_path):
    name = f"t_{uuid.uuid4().hex[:8]}"
    tb.append_table(spark.createDataFrame([(1, "a")], "k int, v string"), name)
    tb.append_table(spark.createDataFrame([("b", 2)], "v string, k int"), name)
    assert sorted(tuple(r) for r in spark.table(name).collect()) == [(1, "a"), (2, "b")]
    tb.swap_table(spark.createDataFrame([(3, "c")], "k int, v string"), name)
    assert [tuple(r) for r in spark.table(name).collect()] == [(3, "c")]
    (tmp_path / "index.json").write_text('{"epis": [{"id": "x", "title": "T"}, {"id": "y"}]}')
    assert sorted((r["id"], r["title"]) for r in tb.read_json_index(spark, str(tmp_path / "index.json"), "id string, title string").collect()) == [("x", "T"), ("y", None)]
    assert tb.read_json_index(spark, str(tmp_path / "none.json"), "id string").count() == 0
    (tmp_path / "LEPs").mkdir()
    (tmp_path / "LEPs" / "a-2010.xml").write_text("<act>\n<x/></act>")
    assert tb.load_document(spark, str(tmp_path), "A-2010!") == "<act>\n<x/></act>"
    with pytest.raises(FileNotFoundError):
        tb.load_document(spark, str(tmp_path), "a-2010", state_policy=True)
    with pytest.raises(ValueError):
        tb.load_document(spark, str(tmp_path), "../!")
    rows = spark.createDataFrame([("a", 2, "Second", "two"), ("a", 1, "First", "one"), ("b", 1, "Only", "x")], "path string, pos int, title string, body string")
    tb.write_markdown(rows, str(tmp_path / "md"))
    back = {r["path"].split("path=")[1][0]: r["body"].strip() for r in tb.read_markdown(spark, str(tmp_path / "md/*/*.txt")).collect()}
    assert back == {"a": "## First\n\none\n\n## Second\n\ntwo", "b": "## Only\n\nx"}
    (tmp_path / "urls.csv").write_text("name,URL\na,http://x\nb, \n")
    assert [r["name"] for r in tb.read_url_csv(spark, str(tmp_path / "urls.csv")).collect()] == ["a"]
    tb.write_csv(spark.createDataFrame([("a", ["x", 'y"z'], None)], "k string, l array<string>, n string"), str(tmp_path / "csv"))
    back = spark.read.csv(str(tmp_path / "csv"), header=True, escape='"').collect()
    assert [tuple(r) for r in back] == [("a", 'x | y"z', None)]


def test_geometry_join(spark):
    shape = lambda dx: sp.write_wkb("Polygon", [[(x + dx, y) for x, y in SQUARE[0]]])
    a = spark.createDataFrame([(i, shape(i * 2.0)) for i in range(6)], "id int, geometry binary")
    b = spark.createDataFrame([(i, shape(i * 3.0)) for i in range(4)], "id int, geometry binary")
    got = {tuple(r) for r in sp.geometry_join(a, b, 1.5, 0.01).collect()}
    assert got == {(i, j) for i in range(6) for j in range(4) if abs(2 * i - 3 * j) < 2 - 0.01}


def test_nearest(spark):
    """Small leaves; ties, places on one spot, groups of one, points far away, rows without a coordinate or a group."""
    rng = np.random.default_rng(2)
    pts = [tuple(p) for p in np.vstack([rng.uniform(0, 100, (300, 2)), rng.uniform(1e6, 2e6, (50, 2)), np.round(rng.uniform(0, 20, (100, 2)))]).tolist()]
    pls = [(*p, "ab"[i % 2]) for i, p in enumerate(np.vstack([rng.uniform(0, 400, (300, 2)), np.round(rng.uniform(0, 20, (300, 2)))]).tolist())] + [(5.0, 5.0, "a")] * 200 + [(-3.0, 1e7, "c")]
    points = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)] + [(9999, None, 1.0)], "id int, x double, y double")
    places = spark.createDataFrame([(i, *p) for i, p in enumerate(pls)] + [(9998, 1.0, None, "a"), (9999, 1.0, 1.0, None)], "place_id int, x double, y double, g string")
    got = {(r["id"], r["g"]): (r["place_id"], r["distance"]) for r in sp.nearest(points, places, "g", 10).collect()}
    assert len(got) == 3 * len(pts)
    at = {k: [(j, p[0], p[1]) for j, p in enumerate(pls) if p[2] == k] for k in "abc"}
    for (i, k), (j, d) in got.items():
        best = min((math.sqrt((pts[i][0] - x) ** 2 + (pts[i][1] - y) ** 2), n) for n, x, y in at[k])
        assert (d, j) == (pytest.approx(best[0]), best[1])
    assert sp.nearest(points, places.limit(0), "g").count() == 0 and sp.nearest(points.limit(0), places, "g").count() == 0


def test_nearest_rounded(spark):
    """Places as far on either side count as equally far when distances are rounded, also over the borders of leaves."""
    rng = np.random.default_rng(5)
    pts = np.round(rng.uniform(-999, 9999, 400), 2).tolist()
    pls = [round(x + s, 2) for x, s in zip(pts, np.round(rng.uniform(0.01, 30, 400), 2).tolist()) for s in (s, -s)]
    order = rng.permutation(len(pls)).tolist()
    points = spark.createDataFrame([(i, x, 0.0) for i, x in enumerate(pts)], "id int, x double, y double")
    places = spark.createDataFrame([(n, x, 0.0, "a") for n, x in zip(order, pls)], "place_id int, x double, y double, g string")
    got = {r["id"]: (r["place_id"], r["distance"]) for r in sp.nearest(points, places, "g", 10, 6).collect()}
    assert got == {i: min((round(abs(p - x), 6), n) for n, x in zip(order, pls))[::-1] for i, p in enumerate(pts)}


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(1, 9), min_size=1, max_size=40))
def test_streams_survive_any_chunking(spark, cuts):
    sent = [("plan", json.dumps({"a": 1})), ("answer_chunk", "hello"), ("message", "not json"), ("error", "")]
    whole, chunks, at = "".join(f"event: {e}\ndata: {d}\n\n" for e, d in sent) + "data: open tail", [], 0
    for n in [*cuts, len("x" * 500)]:
        chunks.append(("r", len(chunks), whole[at : at + n]))
        at += n
    got = ev.parse_runs(spark.createDataFrame(chunks, "run_id string, seq long, chunk string")).orderBy("pos").collect()
    assert [(r["event"], r["data"]) for r in got] == sent


def test_fold(spark):
    rows = [("r", 1, "plan", "a"), ("r", 3, "answer_chunk", "y"), ("r", 2, "answer_chunk", "x"), ("r", 4, "plan", "b"), ("q", 1, "error", "e")]
    got = {r["run_id"]: tuple(r)[1:] for r in ev.fold(spark.createDataFrame(rows, "run_id string, seq long, event string, data string")).collect()}
    assert got == {"r": ("b", "xy", None), "q": (None, "", "e")}


def test_page_views_stream(spark, tmp_path):
    rows = [("s1", "/a", "2024-01-01 00:00:00"), ("s1", "/a", "2024-01-01 00:00:05"), ("s2", "/a", "2024-01-01 00:00:06"), ("s1", "/b", "2024-01-01 00:00:07")]
    df = spark.createDataFrame(rows, "session_id string, path string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = ev.page_views(stream, "10 minutes").writeStream.outputMode("complete").format("memory").queryName("views").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("views").collect()} == {tuple(r) for r in ev.page_views(df).collect()} == {("/a", 2), ("/b", 1)}


def test_parse_stream(spark, tmp_path):
    text = "event: plan\ndata: 1\n\ndata: 2\n\nevent: x\nda"
    chunks = spark.createDataFrame([("r", i, text[i * 7 : i * 7 + 7]) for i in range(9)], "run_id string, seq long, chunk string")
    chunks.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = ev.parse_stream(spark.readStream.schema(chunks.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("parsed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("parsed").collect()] == [("r", "plan", "1"), ("r", "message", "2")]


def test_wide_layers_without_a_shuffle(spark):
    """Joined in buckets: no exchange in the plan, also for as many layers as the catalogue has."""
    from cadastra.operators.layers import CATALOGUE, bucketed, wide_table
    from cadastra.plans import relational  # noqa: F401
    from cadastra.plans.registry import QUERIES

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    wide = QUERIES["wide_layers"](spark, "/root/testdata/sf0.001")
    assert plan(wide).count("SortMergeJoin") == 8 and "Exchange" not in plan(wide)
    name, keys = f"w_{uuid.uuid4().hex[:8]}", ["cadid", "plan"]
    rows = spark.range(40).select(F.col("id").alias("cadid"), F.concat(F.lit("DP"), (F.col("id") % 7).cast("string")).alias("plan"))
    made = [bucketed(rows.filter(f"cadid % {i + 2} = 0").withColumn(x.name, F.lit(i)), f"{name}_{i}", keys, 4) for i, x in enumerate(CATALOGUE)]
    whole = wide_table(spark, bucketed(rows, name, keys, 4), made, keys)
    assert len(CATALOGUE) == 49 and "Exchange" not in plan(whole) and len(whole.columns) == 51
    got = {r["cadid"]: r for r in whole.select("cadid", CATALOGUE[0].name, CATALOGUE[1].name).collect()}
    assert len(got) == 40 and got[6][1:] == (0, 1) and got[4][1:] == (0, None) and got[5][1:] == (None, None)
