"""Legal XML: a small document of our own through elements and what follows from them."""

import random
import tracemalloc
import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from cadastra.operators import layers as ly
from cadastra.operators import legal_xml as lx
from cadastra.operators.spatial import write_wkb
from cadastra.plans import legal
from cadastra.plans.registry import QUERIES

XML = """<act id="lep-1" title="Test Plan">
 <level type="part" id="pt.2"><head><no>2</no><heading>Zones</heading></head>
  <level type="clausegroup" id="pt-cg1.zn"><head><heading>Zone R2 Low Density Residential</heading></head>
   <tier id="t1"><head><heading>Permitted with consent</heading></head><block><txt>Dwelling houses; Dual occupancies; Any other development not specified in item 2</txt></block></tier>
   <tier id="t2"><head><heading>Prohibited</heading></head><block><txt>Pubs; Uses authorised under an Act</txt></block></tier></level>
  <level type="clausegroup" id="z2"><head><heading>Zone RU1 Primary Production</heading></head><tier id="t3"><head><heading>Permitted without consent</heading></head><block><txt>Nil</txt></block></tier></level></level>
 <level type="clause" id="sec.4.1"><head><no>4.1</no><heading>Lots</heading></head><block><txt>In Zone R2 and Zone Objectives, not less than 400 square metres or 40 ha, see clause 5.4. <extref>the Act</extref></txt></block>
  <tier id="sec.4.1-ssec.1"><no>(1)</no><block><txt>Lot Size Map applies.</txt></block></tier></level>
 <level type="clause" id="sec.4.2"><head><heading>All</heading></head><block><txt>At most 8.5 metres or 25%.</txt></block></level>
 <level type="clause" id="sec.4.3" status="repealed"><block><txt>gone</txt></block></level>
 <level type="clause" id="sec.4.4"><block><txt>[Not adopted]</txt></block></level>
 <level type="schedule" id="dict"><defterm type="definition">Pub</defterm><defterm type="definition">pub</defterm><table><row><entry>S</entry><entry>Hall</entry><entry>1 A St</entry><entry>Lot 9, DP 862908</entry><entry>Local</entry><entry>I1</entry></row><row><entry>x</entry></row></table></level>
</act>"""


@pytest.fixture(scope="module")
def e(spark):
    return lx.elements(spark.createDataFrame([("a.xml", XML), ("bad.xml", "<a><b>"), ("none.xml", None)], "path string, xml string")).cache()


def test_elements(e):
    assert {r["path"] for r in e.filter("error is not null").collect()} == {"bad.xml", "none.xml"}
    assert [r["id"] for r in lx.clauses(e).orderBy("pos").collect()] == ["sec.4.1", "sec.4.2"]


def test_zones_and_uses(e):
    assert [(r["code"], r["title"], r["family"]) for r in lx.zones(e).orderBy("code").collect()] == [("R2", "Low Density Residential", "R"), ("RU1", "Primary Production", "RU")]
    got = sorted((r["code"], r["consent"], r["slug"], r["catch_all"]) for r in lx.land_uses(e).collect())
    assert got == [("R2", "prohibited", "pubs", False), ("R2", "with", "any-other-development-not-specified-in-item-2", True), ("R2", "with", "dual-occupancies", False), ("R2", "with", "dwelling-houses", False)]
    assert [(r["term"], r["slug"]) for r in lx.definitions(e).collect()] == [("Pub", "pub")]


def test_indexes(e):
    got = {(r["section"], r["zone_code"]): r for r in lx.zone_index(e).collect()}
    assert set(got) == {("4.1", "R2"), ("4.2", "R2"), ("4.2", "RU1")} and got["4.2", "R2"]["applies_to_all_zones"]
    assert got["4.1", "R2"]["sqm_values"] == [400.0] and got["4.1", "R2"]["map_referenced"]
    lots = {r["section"]: r for r in lx.lot_size_index(e).collect()}
    assert lots["4.1"]["sqm"] == [400.0, 400000.0] and lots["4.1"]["has_map_reference"] and lots["4.1"]["zones_referenced"] == ["R2", "O"]
    req = {r["section"]: (r["value"], r["unit"], r["qualifier"], r["refs"]) for r in lx.requirements(e).collect()}
    assert req == {"4.1": (400.0, "sqm", "min", ["5.4"]), "4.2": (8.5, "m", "min", [])}


def test_structure(e):
    nodes, edges = lx.structure(e)
    found = {tuple(r)[1:] for r in edges.filter("path = 'a.xml'").collect()}
    assert ("sec.4.1", "sec.4.1-ssec.1", "contains") in found and ("sec.4.1", "the Act", "references") in found and any(x[2] == "defines" for x in found)
    assert nodes.groupBy("path", "id").count().filter("count > 1").isEmpty()
    assert [(r["item_no"], r["item_name"]) for r in lx.heritage_items(e).collect()] == [("I1", "Hall")]


RULES = """<act id="lep-2" title="Rule Plan" year="2012"><metacontent class="council"> Test Council </metacontent>
 <level type="part" id="pt.2"><head><no>Part 2</no><heading>Zones</heading></head>
  <level type="clausegroup" id="z1"><head><heading>Zone R2 Low</heading></head><tier id="u1"><head><heading>Permitted with consent</heading></head><block><txt>Dual occupancies; Dairies; Shops</txt></block></tier></level>
  <level type="clausegroup" id="z2"><head><heading>Zone E1 Local</heading></head><tier id="u2"><head><heading>Prohibited</heading></head><block><txt>Pubs</txt></block></tier></level></level>
 <level type="clause" id="sec.3.1"><head><no>3.1</no><heading>Exempt</heading></head><tier id="sec.3.1-ssec.1"><head><no>(1)</no></head><block><txt>The objective of this clause is x.</txt></block></tier>
  <tier id="sec.3.1-ssec.2"><head><no>(2)</no></head><block><txt>Must be minor</txt><note>not this</note><list><li id="q1"><no>(a)</no><block><txt>and safe</txt></block></li></list></block></tier></level>
 <level type="clause" id="sec.3.3"><head><no>3.3</no><heading>Areas</heading></head><tier id="sec.3.3-ssec.2"><block><txt>areas</txt><deflist><block><list><li><no>(a)</no><block><txt>coast, clause 5.5</txt></block></li><li><no>(b)</no><block><txt>parks</txt></block></li></list></block></deflist></block></tier></level>
 <level type="clause" id="sec.4.1"><head><no>4.1</no><heading>Lot size</heading></head>
  <tier id="sec.4.1-ssec.1"><head><no>(1)</no></head><block><txt>The objectives of this clause are</txt><list><li id="o1"><no>(a)</no><block><txt>nothing of note</txt></block></li></list></block></tier>
  <tier id="sec.4.1-ssec.2"><head><no>(2)</no></head><block><txt>In Zone R2 a dairy needs</txt><list><li id="i1"><no>(a)</no><block><txt>not less than 500 square metres, and</txt><list><li id="i2"><no>(i)</no><block><txt>25% of shop fronts</txt></block></li></list></block></li><li><no>(b)</no><block><txt>8.5 metres</txt></block></li><li><no>(c)</no><block><txt>later</txt></block></li></list></block></tier>
  <tier id="sec.4.1-ssec.3" status="repealed"><block><txt>a repealed subclause</txt></block></tier></level>
 <level type="clause" id="sec.5.3"><head><no>5.3</no><heading>Zone edges</heading></head>
  <tier id="sec.5.3-ssec.1"><head><no>(1)</no></head><block><txt>This clause applies to a pub:</txt><list><li id="p1"><no>(a)</no><block><txt>near roads</txt><list><li id="p2"><no>(i)</no><block><txt>deep down</txt></block></li></list></block></li></list></block></tier></level>
 <level type="clause" id="sec.5.4"><head><no>5.4</no><heading>Controls</heading></head>
  <tier id="sec.5.4-ssec.1"><head><no>(1)</no><heading>Bed and breakfast</heading></head><block><txt>no more than 3 bedrooms in Zone R2 or Zone X9</txt></block></tier>
  <tier id="sec.5.4-ssec.7AA"><head><no>(7AA)</no><heading>Kiosks</heading></head><block><txt>must not exceed 1,200 square metres</txt></block></tier>
  <tier id="sec.5.4-ssec.8"><head><no>(8)</no><heading>None</heading></head><block><txt>[Not adopted]</txt></block></tier></level>
 <level type="clause" id="sec.5.5"><head><no>5.5</no><heading>Coast</heading></head><block><list><li id="c1"><no>(a)</no><block><txt>at least 10 metres</txt><list><li id="c2"><no>(i)</no><block><txt>of sand</txt></block></li></list></block></li><li id="c3"><no>(b)</no><block><txt>[Not applicable]</txt></block></li></list></block></level>
 <level type="clause" id="sec.5.6"><head><no>5.6</no><heading>Roofs</heading></head><block><txt>[Not adopted]</txt></block></level>
 <level type="part" id="pt.6"><head><no>Part 6</no><heading>Local</heading></head><level type="clause" id="sec.6.1"><head><no>6.1</no><heading>Earthworks</heading></head>
  <tier id="sec.6.1-ssec.1"><head><no>(1)</no></head><block><txt>The objective of this clause is order.</txt></block></tier><tier id="sec.6.1-ssec.2"><head><no>(2)</no></head><block><txt>Consent is needed.</txt></block></tier></level>
  <level type="clause" id="sec.6.2"><head><no>6.2</no><heading>Bare</heading></head></level></level>
 <level type="schedule" id="sch.1"><level type="clause" id="sch.1-sec.1"><head><no>1</no><heading>Use of certain land at 5 Main Road, Town</heading></head>
  <tier id="sch.1-sec.1-ssec.1"><block><txt>This clause applies to Lots 3 and 4, DP 1234, Town.</txt></block></tier><tier id="sch.1-sec.1-ssec.2"><block><txt>Development for the purposes of a shops, and kiosks is permitted with consent.</txt></block></tier></level></level>
 <level type="schedule" id="sch.2"><level type="clause" id="sch.2-sec.1"><head><heading>Signs</heading></head><tier id="sch.2-sec.1-ssec.1"><block><txt>Small ones in Zone E1</txt></block></tier><tier id="sch.2-sec.1-ssec.2"><block><txt>Flat ones</txt></block></tier></level><level type="clause" id="sch.2-sec.2"><head><heading>Empty</heading></head></level></level>
 <level type="schedule" id="sch.3"><level type="part" id="sch.3-pt.1"><level type="clause" id="sch.3-sec.1"><head><heading>Pools</heading></head><tier id="sch.3-sec.1-ssec.1"><block><txt>Fenced</txt></block></tier></level></level>
  <level type="part" id="sch.3-pt.2"><level type="clause" id="sch.3-sec.9"><head><heading>Conditions</heading></head><tier id="sch.3-sec.9-ssec.1"><block><txt>Other</txt></block></tier></level></level></level>
</act>"""


@pytest.fixture(scope="module")
def rules(spark):
    return lx.elements(spark.createDataFrame([("r.xml", RULES), ("bad.xml", "<a")], "path string, xml string")).cache()


def by_tree(path, xml):
    """The rows of a document from the tree of all its elements."""
    flat = lambda x: " ".join("".join(x.itertext()).split())

    def own(x):
        parts = [x.text or ""]
        for y in x:
            parts += ["" if y.tag in ("level", "tier", "li", "head", "note", "no") else own(y), y.tail or ""]
        return " ".join(" ".join(parts).split())

    def said(block):
        parts = []
        for x in block if block is not None else ():
            if x.tag == "txt":
                parts.append(flat(x))
            for item in x.findall("li") if x.tag == "list" else ():
                text, no = said(item.find("block")), item.find("no")
                parts.append(f"{flat(no)} {text}" if text and no is not None else text)
        return " ".join(" ".join(parts).split())

    rows = []

    def go(x, parent, depth, within, clause, tier, label):
        if parent is None or x.tag in ("level", "tier", "li", "defterm", "extref", "legref", "row", "metacontent"):
            at, head, block, layer = len(rows), x.find("head"), x.find("block"), x.tag in ("level", "tier", "li")
            no = x.find("no") if head is None or head.find("no") is None else head.find("no")
            heading, kind = None if head is None else head.find("heading"), x.get("type") or x.get("class")
            number, txt = None if no is None else flat(no), None if block is None else block.find("txt")
            label = ("" if kind == "clause" else label) + ((number or "").replace(" ", "") if layer else "")
            text = " | ".join(map(flat, x.iter("entry"))) if x.tag == "row" else own(x)
            rows.append((path, at, parent, depth, x.tag, x.get("id"), kind, x.get("status"), number, None if heading is None else flat(heading), text, None, within, clause, tier, label or None,
                         None if txt is None else flat(txt), None if block is None else said(block), flat(x) if layer else None, *[x.get(k) if parent is None else None for k in ("title", "year")]))
            parent, depth = at, depth + 1
            if x.tag == "level":
                within, clause, tier = f"{within}/{x.get('id') or ''}", at if kind == "clause" else None, None
            tier = at if x.tag == "tier" else tier
        for y in x:
            go(y, parent, depth, within, clause, tier, label)

    go(ET.fromstring(xml), None, 0, "", None, None, "")
    return rows


def walked(xml, step):
    return sorted((r for rows in lx.walk("p", lambda: (xml[i : i + step] for i in range(0, len(xml), step))) for r in rows), key=lambda r: r[1])


def test_walk_against_the_tree():
    """Elements anywhere in each other, numbers and heads behind what they count for, and documents cut anywhere."""
    rng = random.Random(3)
    tags = "level tier li defterm extref row metacontent head no heading block txt list note entry x li no head block txt list entry".split()
    kinds = [("id", ["a", "b c", "", None]), ("type", ["clause", None]), ("class", ["council", None]), ("title", ["T", None])]
    texts = ["", " ", "a", "bb c", "\n", "é x", "&amp;", "<!-- c -->", "(1) "]

    def made(d):
        tag, own = rng.choice(tags), "".join(f' {k}="{v}"' for k, vs in kinds if (v := rng.choice(vs)) is not None)
        return f"<{tag}{own}>{rng.choice(texts)}{''.join(rng.choice(texts) + made(d - 1) for _ in range(rng.randint(0, 4) if d else 0))}</{tag}>"

    for xml in [XML, RULES, *[made(rng.randint(0, 6)) for _ in range(600)]]:
        assert walked(xml, rng.choice([1, 7, 1 << 20])) == by_tree("p", xml)
    long = f"<level><block><txt>{'é  word ' * 400_000}</txt></block></level>"
    assert walked(long, 1 << 16) == by_tree("p", long)


def test_walk_holds_no_tree():
    """What is held grows with the text of the open elements, not with the number of elements."""
    pieces = lambda: ('<act><level type="schedule" id="s">', *(f'<tier id="t{i}"><head><no>({i})</no></head><block><txt>a</txt></block></tier>' for i in range(30_000)), "</level></act>")
    tracemalloc.start()
    n = sum(len(rows) for rows in lx.walk("p", pieces))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 30_002 and most < 12_000_000  # the tree alone takes 29 MB


def test_elements_of_pieces(spark):
    """Documents in pieces in any order of rows; one of them can't be parsed, one goes to a file."""
    docs = {"a.xml": XML, "r.xml": RULES, "bad.xml": "<act><level id='1'/><b>", "long.xml": f"<level><!--{'x' * lx.HELD}--><li>é\r\n</li></level>"}
    rows = [(p, k, x[i : i + n]) for p, x in docs.items() for n in [37 if len(x) < 99_999 else 99_999] for k, i in enumerate(range(0, len(x), n))]
    random.Random(1).shuffle(rows)
    got = lx.elements_of_pieces(spark.createDataFrame(rows, "path string, k int, xml string"), ["k"]).collect()
    want = lx.elements(spark.createDataFrame(list(docs.items()), "path string, xml string")).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and [r["error"] is not None for r in got if r["path"] == "bad.xml"] == [True]


@pytest.mark.parametrize("name", ["sections", "definitions", "heritage", "prerequisites", "schedule_items", "requirements", "requirement_tree", "controls", "zones"])
def test_no_document_is_one_value(spark, name, monkeypatch):
    """The queries' documents are rows of a few hundred characters, however many parts a brand has."""
    made = []
    real = lx.elements_of_pieces
    monkeypatch.setattr(legal, "_ELEMENTS", {})
    monkeypatch.setattr(lx, "elements_of_pieces", lambda pieces, by: made.append(pieces) or real(pieces, by))
    assert QUERIES[f"xml_{name}"](spark, "/root/testdata/sf0.001").count()
    assert made[0].selectExpr("max(length(xml))").first()[0] < 1000


def test_requirement_tree(rules):
    tree = lx.requirement_tree(rules).cache()
    got = {r["section_id"]: (r["parent_id"], r["clause_id"], r["value"], r["unit"], r["qualifier"]) for r in tree.collect()}
    assert got == {
        "sec.4.1": (None, "4.1", None, "map-reference", None),
        "sec.4.1-ssec.2": ("req:sec.4.1", "4.1(2)", 500.0, "sqm", "min"),
        "i1": ("req:sec.4.1-ssec.2", "4.1(2)(a)", 500.0, "sqm", "min"),
        "i2": ("req:i1", "4.1(2)(a)(i)", 25.0, "%", "max"),
        "sec.4.1-ssec.2-li": ("req:sec.4.1-ssec.2", "4.1(2)(b)", 8.5, "m", "min"),  # items without an id share one: the first counts
        "sec.5.3": (None, "5.3", None, "map-reference", None),
        "p1": ("req:sec.5.3", "5.3(1)(a)", None, None, None),
        "sec.5.5": (None, "5.5", None, "map-reference", None),
        "c1": ("req:sec.5.5", "5.5(a)", 10.0, "m", "min"),
        "c2": ("req:c1", "5.5(a)(i)", None, None, None),
    }
    said = {r["section_id"]: r["description"] for r in tree.collect()}
    assert said["p1"] == "This clause applies to a pub: (a) near roads (i) deep down" and said["i1"] == "not less than 500 square metres, and (i) 25% of shop fronts"
    zones = {(r["id"], r["zone"]) for r in lx.requirement_zones(tree, rules).collect()}
    assert ("req:i2", "R2") in zones and ("req:i2", "E1") not in zones and {("req:sec.5.5", "R2"), ("req:sec.5.5", "E1")} <= zones
    uses = {(r["id"], r["use_slug"]) for r in lx.requirement_uses(tree, rules).collect()}
    assert uses == {("req:sec.4.1", "dairies"), ("req:sec.4.1", "shops"), ("req:sec.4.1-ssec.2", "dairies"), ("req:sec.4.1-ssec.2", "shops"), ("req:i1", "shops"), ("req:i2", "shops")}  # a use of four letters keeps its s


def test_zoned_terms_and_lot_sizes(rules):
    assert {(r["slug"], r["term"]) for r in lx.zoned_terms(rules).collect()} == {("dual-occupancies", "dual occupancies"), ("dairies", "dairies"), ("shops", "shops"), ("pubs", "pubs")}
    lots = {r["section"]: r for r in lx.lot_size_index(rules).collect()}
    assert set(lots) == {"4.1"} and lots["4.1"]["sqm"] == [500.0] and "not less than 500 square metres" in lots["4.1"]["context"]
    assert [r["number"] for r in lots["4.1"]["subclauses"]] == ["(1)", "(2)"]


def test_controls(rules):
    got = [(r["clause_id"], r["use_slug"], r["value"], r["unit"], r["zones"]) for r in lx.controls(rules).orderBy("id").collect()]
    assert got == [("5.4(1)", "bed-and-breakfast", 3.0, "bedrooms", ["R2"]), ("5.4(7AA)", "kiosks", 1200.0, "sqm", [])]


def test_other_parts(rules):
    assert [tuple(r)[1:] for r in lx.plan_info(rules).collect()] == [("lep-2", "Rule Plan", "2012", "Test Council")]
    assert {(r["kind"], r["text"]) for r in lx.prerequisites(rules).collect()} == {("exempt", "Must be minor (a) and safe"), ("excluded", "coast, clause 5.5"), ("excluded", "parks")}
    assert [(r["letter"], r["refs"]) for r in lx.exclusion_areas(rules).orderBy("pos").collect()] == [("a", ["5.5"]), ("b", [])]
    items = {r["heading"]: (r["consent"], r["zones"], r["conditions"]) for r in lx.schedule_items(rules).collect()}
    assert items == {"Signs": ("exempt", ["E1"], ["Small ones in Zone E1", "Flat ones"]), "Pools": ("complying", [], ["Fenced"])}
    site = lx.additional_uses(rules).collect()
    assert [(r["address"], r["lots"], r["use_slugs"]) for r in site] == [("5 Main Road, Town", "Lots 3 and 4, DP 1234", ["shops"])]
    assert [(r["number"], r["title"], r["summary"]) for r in lx.local_provisions(rules).orderBy("id").collect()] == [("6.1", "Earthworks", "(2)Consent is needed."), ("6.2", "Bare", "")]
    assert {(r["id"], r["part"]) for r in lx.sections(rules).collect()} >= {("pt.2", 2), ("sec.4.1", 4), ("sec.5.5", 5)}
    md = {r["title"]: r["body"] for r in lx.markdown_sections(rules).collect()}
    assert md["6.2 Bare [sec.6.2]"] == "" and md["3.1 Exempt [sec.3.1]"].endswith("(2) Must be minor (a) and safe")


def test_extract(spark):
    """From files to all tables in one call."""
    found = lx.extract(spark.createDataFrame([("a.xml", XML), ("r.xml", RULES), ("bad.xml", "<a")], "path string, xml string"))
    n = {name: t.count() for name, t in found.items()}
    assert n["errors"] == 1 and n["plans"] == 2 and n["zones"] == 4 and n["heritage"] == 1 and all(v > 0 for v in n.values())


def test_site_lots(spark):
    df = spark.createDataFrame([("being Lot 9, DP 862908 and Lots 7300 and 7301, DP 1153423",)], "t string")
    assert df.select(lx.site_lots(F.col("t"))).first()[0] == ["Lot 9, DP 862908", "Lots 7300 and 7301, DP 1153423"]


def test_layers(spark):
    known = {x.name: x for x in ly.CATALOGUE}
    assert len(known) == 49 and known["lzn_historic"].history and known["floodsdf"].geometry == "wkb_geometry" and known["suburb"].place == "centroid"
    box = lambda x, w=1.0: write_wkb("Polygon", [[(x, 0.0), (x + w, 0.0), (x + w, 1.0), (x, 1.0), (x, 0.0)]])
    lots = spark.createDataFrame([(1, box(0.0)), (2, box(1.0)), (3, box(50.0))], "lot_id int, geometry binary")
    zones = spark.createDataFrame([("R2", "Low", "E", None, box(0.0)), ("E1", "Local", "E", "x", box(0.5, 1.0)), (None, "Low", "E", None, box(0.0))], "SYM_CODE string, LAY_CLASS string, EPI_NAME string, LABEL string, geometry binary")
    hist = spark.createDataFrame([("B", "2001", "2020-01-01", box(0.0)), ("A", "2002", "2020-01-01", box(0.0)), ("C", "2003", "9999-01-01", box(0.0))], "sym_code string, commenced_datetime string, published_datetime string, geometry binary")
    hist = hist.withColumns({"lay_class": F.col("sym_code"), "amendment": F.col("sym_code")})
    broken = hist.select("geometry")  # a layer whose columns are missing fails by itself
    suburbs = spark.createDataFrame([("West", "1", box(-9.0, 10.0)), ("East", "2", box(1.0, 9.0))], "SUBURBNAME string, POSTCODE string, geometry binary")
    wide, failed = ly.enrich(lots, {"Suburbs": suburbs, "Land_Zoning_Map": zones, "land_zoning_map_historic": hist, "Floor_Space_Ratio_Map": broken}, 1.0)
    got = {r["lot_id"]: r for r in wide.collect()}
    # lots 1 and 2 share a border with both suburbs; their centroids lie in one
    assert [got[i]["suburbname"] for i in (1, 2, 3)] == ["West", "East", None]
    assert list(failed) == ["fsr"] and "FSR" in failed["fsr"]
    assert (got[1]["lzn_sym_code"], got[2]["lzn_sym_code"], got[3]["lzn_sym_code"]) == ("E1, R2", "E1", None)
    assert got[1]["historic_zone"] == "B | A" and got[1]["lzn_label"] == "x"
