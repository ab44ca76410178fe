"""Legal XML to tables: a walk of the elements in Python as they are parsed, everything else as joins, regular expressions and explodes.

elements() gives one row for each element that structures a document (level, tier, li, defterm, reference, table row). The other
functions turn these rows into zones, land uses, requirements, a structure graph and index records.
"""

from __future__ import annotations

import codecs
import tempfile
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadastra.functions.text import HECTARES, METRES, PERCENT, SQUARE_METRES, clause_refs, metric, numbers, plural_hit, slug, zone_family, zone_mentions
from cadastra.operators.relational import first_by
from cadastra.sources.tables import written

FIELDS = (
    "path string, pos int, parent int, depth int, tag string, id string, kind string, status string, number string, heading string, text string, error string, "
    "within string, clause int, tier int, label string, lead string, block string, whole string, title string, year string"
)
_KEPT = {"level", "tier", "li", "defterm", "extref", "legref", "row", "metacontent"}
_LAYERS = {"level", "tier", "li"}


#: Characters fed to the parser at a time; characters of a document that are held before it goes to a temporary file; rows and characters in a batch, about.
FEED, HELD, ROWS, LONG = 1 << 16, 1 << 23, 2000, 1 << 22


def _said(raw: bytearray, begin: int = 0) -> str:
    """The text from a place on with single spaces, a megabyte at a time where it is long."""
    if len(raw) - begin < 1 << 20:
        return " ".join(raw[begin:].decode().split())
    decoder, out, space = codecs.getincrementaldecoder("utf-8")(), [], False
    for k in range(begin, len(raw), 1 << 20):
        t = decoder.decode(raw[k : k + (1 << 20)])
        words = " ".join(t.split())
        if words:
            out += [" ", words] if out and (space or t[0].isspace()) else [words]
            space = t[-1].isspace()
        else:
            space = space or bool(t)
    return "".join(out)


class _Kept:
    """An open element that gives a row."""

    __slots__ = ("at", "parent", "depth", "tag", "attrib", "kind", "within", "clause", "tier", "base", "layer", "below", "seen", "head_no", "no", "heading", "block", "lead", "whole", "own", "entries", "frozen", "listed")

    def __init__(self, at: int, tag: str, attrib: dict, up: _Kept | None, label: str):
        self.at, self.tag, self.attrib, self.kind = at, tag, attrib, attrib.get("type") or attrib.get("class")
        self.parent, self.depth, (self.within, self.clause, self.tier) = (None, 0, ("", None, None)) if up is None else (up.at, up.depth + 1, up.below)
        self.base, self.layer = "" if self.kind == "clause" else label, tag in _LAYERS
        self.below = self.within, self.clause, self.tier
        if tag == "level":
            self.below = f"{self.within}/{attrib.get('id') or ''}", at if self.kind == "clause" else None, None
        elif tag == "tier":
            self.below = self.within, self.clause, at
        self.seen, self.entries = set(), []
        self.head_no = self.no = self.heading = self.block = self.lead = self.listed = None
        self.frozen = False  # the number when the first element below began

    def number(self) -> str | None:
        return self.no if self.head_no is None else self.head_no


class _Walker:
    """A parser's target that makes the rows of a document as its elements end, and holds what is open only: its text, not its elements.

    late: the numbers of layers that stand behind elements for whose labels they count; they are learnt by a walk before.
    """

    def __init__(self, path: str, late: dict[int, str | None] | None = None):
        self.path, self.late, self.learnt = path, late or {}, {}
        self.rows, self.held, self.count = [], 0, 0
        # open elements as (kept, role, whose, begin of text, texts around); texts: all, and that of the layer without its head, notes and layers
        self.open, self.top, self.tops, self.in_rows = [], None, [], []
        self.raw, self.own, self.reading = bytearray(), bytearray(), 0

    def start(self, tag: str, attrib: dict) -> None:
        own, role, of, kept, begin, around = self.own, None, None, None, -1, None
        own += b" "
        up, up_role, up_of = self.open[-1][:3] if self.open else (None, None, None)
        if tag == "txt":
            if up_role == "block":
                role, of = "txt", up_of
        elif tag == "no":
            if up_role == "head" and "head no" not in up_of.seen:
                role, of = "head no", up_of
            elif up is not None and "no" not in up.seen:
                role, of = "no", up
        elif tag == "heading":
            if up_role == "head" and "heading" not in up_of.seen:
                role, of = "heading", up_of
        elif tag in ("head", "block"):
            if up is not None and tag not in up.seen:
                role, of = tag, up
                if tag == "block":
                    up.block = bytearray()
        elif tag == "list":
            if up_role == "block":
                role, of = "list", up_of
        elif tag == "entry" and self.in_rows:
            role, of = "entry", [(k, len(k.entries)) for k in self.in_rows]
            for k in self.in_rows:
                k.entries.append("")
        if role in ("head", "block", "no", "head no", "heading"):
            of.seen.add(role)
        if not self.open or tag in _KEPT:
            top = self.top
            label = ""
            if top is not None:
                number = top.number()
                if top.frozen is False:
                    top.frozen = number
                label = top.base + (self.late.get(top.at, number) or "").replace(" ", "") if top.layer else top.base
            kept = _Kept(self.count, tag, attrib, top, label)
            self.count += 1
            if tag == "li" and up_role == "list":
                kept.listed = up_of
            self.tops.append(top)
            self.top = kept
            if tag == "row":
                self.in_rows.append(kept)
        if tag in _LAYERS or role in ("no", "head no", "heading", "txt", "entry"):
            begin = len(self.raw)
            self.reading += 1
        if not self.open or tag in _LAYERS or tag in ("head", "note", "no"):
            around, self.own = own, bytearray()
        if kept is not None:
            kept.own = len(self.own)
        self.open.append((kept, role, of, begin, around))

    def data(self, text: str) -> None:
        text = text.encode()
        self.own += text
        if self.reading:
            self.raw += text

    def end(self, tag: str) -> None:
        kept, role, of, begin, around = self.open.pop()
        said = None
        if begin >= 0:
            said = _said(self.raw, begin)
            self.reading -= 1
            if not self.reading:
                self.raw.clear()
        if role == "txt":
            of.lead = said if of.lead is None else of.lead
            of.block += b" " + said.encode()
        elif role == "no":
            of.no = said
        elif role == "head no":
            of.head_no = said
        elif role == "heading":
            of.heading = said
        elif role == "entry":
            for k, i in of:
                k.entries[i] = said
        if kept is not None:
            self.top = self.tops.pop()
            if tag == "row":
                self.in_rows.pop()
            self._row(kept, said if kept.layer else None)
        if around is not None:
            self.own = around
        else:
            self.own += b" "

    def _row(self, k: _Kept, whole: str | None) -> None:
        text = " | ".join(k.entries) if k.tag == "row" else _said(self.own, k.own)
        number, block, get = k.number(), None if k.block is None else _said(k.block), k.attrib.get
        if k.layer and k.frozen is not False and k.frozen != number:
            self.learnt[k.at] = number
        label = k.base + (number or "").replace(" ", "") if k.layer else k.base
        if k.listed is not None:
            k.listed.block += b" " + (f"{k.no} {block}" if block and k.no is not None else block or "").encode()
        root = k.parent is None
        self.rows.append((
            self.path, k.at, k.parent, k.depth, k.tag, get("id"), k.kind, get("status"), number, k.heading, text, None,
            k.within, k.clause, k.tier, label or None, k.lead, block, whole, get("title") if root else None, get("year") if root else None,
        ))
        self.held += len(text) + len(block or "") + len(whole or "")


class _Order:
    """A parser's target that finds out whether a head or a number stands behind, or around, an element that gives a row."""

    def __init__(self):
        self.open, self.late = [], False

    def start(self, tag: str, attrib: dict) -> None:
        if self.open and self.open[-1] and tag in ("head", "no"):
            self.late = True
        self.open.append(False)

    def end(self, tag: str) -> None:
        below = self.open.pop()
        if below and tag == "no":
            self.late = True
        if self.open and (below or tag in _KEPT):
            self.open[-1] = True


def _fed(target: _Walker | _Order, pieces: Iterable[str]) -> Iterator[None]:
    """Parse a document's pieces, with a stop after each."""
    parser = ET.XMLParser(target=target)
    for x in pieces:
        parser.feed(x)
        yield
    parser.close()
    yield


def walk(path: str, pieces: Callable[[], Iterable[str]]) -> Iterator[list[tuple]]:
    """The rows of one document, some at a time, as its elements end; a document that can't be parsed gives one row with the error, cut to 200 characters.

    pieces: gives the document's text in pieces, each time that it is called; it is read twice, for errors and for the rows.

    within: the ids of the levels around an element; clause, tier: the places of those nearest around it; label: the numbers from the
    clause down to it; lead, block: the first text of its block, and all of it as it is read; whole: all its text.
    """
    order, late = _Order(), {}
    try:
        for _ in _fed(order, pieces()):
            pass
    except ET.ParseError as e:
        yield [(path, 0, None, 0, *[None] * 7, str(e)[:200], *[None] * 9)]
        return
    if order.late:
        before = _Walker(path)
        for _ in _fed(before, pieces()):
            before.rows.clear()
        late = before.learnt
    walker = _Walker(path, late)
    for _ in _fed(walker, pieces()):
        if len(walker.rows) >= ROWS or walker.held >= LONG:
            yield walker.rows
            walker.rows, walker.held = [], 0
    yield walker.rows


def _cut(xml: str) -> Iterator[str]:
    return (xml[i : i + FEED] for i in range(0, len(xml), FEED))


def _read(file) -> Iterator[str]:
    file.seek(0)
    return iter(lambda: file.read(FEED), "")


_NAMES, _TYPES = zip(*[f.split() for f in FIELDS.split(", ")], strict=True)


def _packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([r[i] for r in rows], pa.int32() if t == "int" else pa.string()) for i, t in enumerate(_TYPES)], list(_NAMES))


def elements(files: DataFrame) -> DataFrame:
    """files (path, xml) to one row an element, of which pos counts the order in the document; see FIELDS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, xml in zip(b.column(0), b.column(1), strict=True):
                text = xml.as_py() or ""
                for rows in walk(path.as_py(), lambda: _cut(text)):
                    yield _packed(rows)

    return files.select("path", "xml").mapInArrow(run, FIELDS)


def elements_of_pieces(pieces: DataFrame, by: list[str]) -> DataFrame:
    """elements() of documents that are given in pieces (path, xml), to be put one behind the other in the order of `by`: no document is a single value, nor held as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((path.as_py(), xml.as_py() or "") for b in batches for path, xml in zip(b.column(0), b.column(1), strict=True))
        for path, own in groupby(rows, lambda r: r[0]):
            with tempfile.SpooledTemporaryFile(HELD, "w+", encoding="utf-8", newline="") as file:
                for _, xml in own:
                    file.write(xml)
                for found in walk(path, lambda: _read(file)):
                    yield _packed(found)

    tasks = int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pieces.repartition(tasks, "path").sortWithinPartitions("path", *by).select("path", "xml").mapInArrow(run, FIELDS)


def clauses(e: DataFrame) -> DataFrame:
    """Clause levels in force with their full text (own and below), and the code of what they belong to; `[Not adopted]` is left out."""
    heads = e.filter("tag = 'level' and kind = 'clause' and coalesce(status, '') != 'repealed'")
    # the text below a clause: every element up to the next clause of the document
    last = F.last(F.when((F.col("tag") == "level"), F.col("pos")), ignorenulls=True).over(Window.partitionBy("path").orderBy("pos"))
    body = e.withColumn("_head", last).filter("tag in ('level', 'tier', 'li')").groupBy("path", "_head").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), " ").alias("full_text"))
    out = heads.join(body, (heads["path"] == body["path"]) & (heads["pos"] == body["_head"])).drop(body["path"]).drop("_head")
    return out.filter(~F.trim("full_text").startswith("[Not adopted]")).withColumn("section", F.regexp_replace("id", r"^sec\.", ""))


def zones(e: DataFrame) -> DataFrame:
    """(path, code, title, family) of the headings `Zone X Title` of the land-use table, each code once."""
    heads = e.filter("tag = 'level'").withColumn("_h", F.trim(F.concat_ws(" ", "number", "heading")))
    found = heads.withColumn("code", F.regexp_extract("_h", r"^Zone\s+([A-Z]+\d*)\b", 1)).filter("code != ''")
    first = first_by(found, ["path", "code"], [F.col("pos")])
    return first.select("path", "pos", "id", "code", F.trim(F.regexp_replace("_h", r"^Zone\s+[A-Z]+\d*", "")).alias("title"), zone_family(F.col("code")).alias("family"))


def land_uses(e: DataFrame) -> DataFrame:
    """(path, code, consent, use, slug, catch_all, pos): what a zone's tiers 2 to 4 permit or prohibit, split at semicolons."""
    z = zones(e).select("path", F.col("pos").alias("_zone"), "code")
    tiers = e.filter("tag = 'tier'").join(z, (F.col("parent") == F.col("_zone")) & (e["path"] == z["path"])).drop(z["path"])
    low = F.lower(F.concat_ws(" ", "heading", "number"))
    consent = F.when(low.contains("without consent"), "without").when(low.contains("with consent"), "with").when(low.contains("prohibited"), "prohibited")
    below = e.filter("tag = 'li'").select("path", F.col("parent").alias("_tier"), F.col("text").alias("_item"))
    text = tiers.withColumn("consent", consent).filter("consent is not null")
    items = text.select("path", "code", "consent", "pos", F.explode(F.split("text", r";\s*")).alias("use"))
    listed = text.join(below, (text["pos"] == below["_tier"]) & (text["path"] == below["path"])).select(text["path"], "code", "consent", "pos", F.explode(F.split("_item", r";\s*")).alias("use"))
    use = items.unionByName(listed).withColumn("use", F.trim(F.regexp_replace("use", r"\.\s*$", ""))).filter("use != '' and not lower(use) like 'uses authorised under%' and lower(use) != 'nil'")
    use = use.groupBy("path", "code", "consent", "use").agg(F.min("pos").alias("pos"))
    return use.select("path", "code", "consent", "use", slug(F.col("use")).alias("slug"), F.lower("use").contains("any other development not specified").alias("catch_all"), "pos")


def zoned_terms(e: DataFrame) -> DataFrame:
    """(path, slug, term): the uses of the zone tables, lower case, the first of each slug; terms of up to three characters stay out."""
    uses = land_uses(e).filter("not catch_all and length(use) > 3")
    return first_by(uses, ["path", "slug"], [F.col("pos"), F.col("use")]).select("path", "slug", F.lower("use").alias("term"))


def definitions(e: DataFrame) -> DataFrame:
    """(path, term, slug) of dictionary terms, the first of each slug."""
    found = e.filter("tag = 'defterm' and kind = 'definition' and text != ''").withColumn("slug", slug(F.col("text")))
    return first_by(found, ["path", "slug"], [F.col("pos")]).select("path", F.col("text").alias("term"), "slug")


def requirements(e: DataFrame, parts: str = r"^[456]\.") -> DataFrame:
    """(path, section, heading, value, unit, qualifier, refs): clauses of the named parts with their first measure and what they refer to."""
    rows = clauses(e).filter(F.col("section").rlike(parts)).withColumn("_m", metric(F.col("full_text")))
    return rows.select("path", "section", "heading", "_m.value", "_m.unit", "_m.qualifier", clause_refs(F.col("full_text")).alias("refs"))


def zone_index(e: DataFrame, parts: str = r"^[456]\.") -> DataFrame:
    """One row a clause and zone that it applies to: the known zones that it names, or all of the document's where it names none."""
    known = zones(e).groupBy("path").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    rows = clauses(e).filter(F.col("section").rlike(parts)).join(known, "path", "left")
    named = F.array_intersect(zone_mentions(F.col("full_text")), F.coalesce("codes", F.array().cast("array<string>")))
    every = F.size(named) == 0
    measured = {"sqm_values": SQUARE_METRES, "ha_values": HECTARES, "m_values": METRES, "percent_values": PERCENT}
    out = rows.select("path", "section", "heading", every.alias("applies_to_all_zones"), F.explode_outer(F.when(every, F.col("codes")).otherwise(named)).alias("zone_code"), *[numbers(F.col("full_text"), p).alias(n) for n, p in measured.items()], F.lower("full_text").contains("map").alias("map_referenced"))
    return out.withColumn("zone_family", zone_family(F.col("zone_code")))


def lot_size_index(e: DataFrame) -> DataFrame:
    """Clauses on lot sizes: square metres, hectares as square metres, each once, with up to 100 characters around the first, the zones named,
    their subclauses, and 8,000 characters of text."""
    said = _subclauses(e).groupBy("path", F.col("clause").alias("_clause")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "number", "block"))), lambda x: F.struct(x["number"].alias("number"), x["block"].alias("text"))).alias("subclauses"))
    rows = clauses(e).filter(F.col("section").rlike(r"^(4\.|2\.6)")).drop("clause").withColumnRenamed("pos", "_clause").join(said, ["path", "_clause"], "left")
    context = F.nullif(F.regexp_extract("full_text", rf"(?s)(.{{0,100}}{SQUARE_METRES}.{{0,100}})", 1), F.lit(""))
    hectares = F.transform(numbers(F.col("full_text"), HECTARES), lambda x: F.round(x * 10000))
    sizes = F.array_distinct(F.concat(numbers(F.col("full_text"), SQUARE_METRES), hectares))
    return rows.select("path", "section", "heading", zone_mentions(F.col("full_text")).alias("zones_referenced"), sizes.alias("sqm"), context.alias("context"), "subclauses", F.lower("full_text").contains("lot size map").alias("has_map_reference"), F.substring("full_text", 1, 8000).alias("raw_text"))


def structure(e: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): elements with identifiers, generated where they have none; contains, defines and references edges.

    Nodes are one a path and id, the first in the document; edges are kept as often as they occur.
    """
    named = e.filter("tag is not null").withColumn("id", F.coalesce("id", F.concat(F.col("tag"), F.lit("-auto-"), F.col("pos").cast("string"))))
    nodes = first_by(named.filter("tag in ('level', 'tier', 'li', 'defterm') or parent is null"), ["path", "id"], [F.col("pos")]).select("path", "id", "tag", "number", "heading", "text")
    p = named.select(F.col("path").alias("_path"), F.col("pos").alias("_pos"), F.col("id").alias("source"))
    both = named.join(p, (F.col("path") == F.col("_path")) & (F.col("parent") == F.col("_pos")))
    relation = F.when(F.col("tag") == "defterm", "defines").when(F.col("tag").isin("extref", "legref"), "references").when(F.col("tag") != "row", "contains")
    target = F.when(F.col("tag").isin("extref", "legref"), F.coalesce(F.nullif("text", F.lit("")), F.col("id"))).otherwise(F.col("id"))
    return nodes, both.withColumn("relation", relation).filter("relation is not null").select("path", "source", target.alias("target"), "relation")


def heritage_items(e: DataFrame) -> DataFrame:
    """Rows of at least six cells in schedule 5's tables: locality, name, address, property, significance, number; number and name are required."""
    cells = F.split("text", r" \| ")
    out = e.filter((F.col("tag") == "row")).withColumn("c", cells).filter("size(c) >= 6")
    names = ["suburb", "item_name", "address", "property_description", "significance", "item_no"]
    return out.select("path", "pos", *[F.trim(F.col("c")[i]).alias(n) for i, n in enumerate(names)]).filter("item_name != '' and item_no != '' and lower(item_name) != 'item name'")


def plan_info(e: DataFrame) -> DataFrame:
    """(path, id, title, year, council) of each document."""
    council = e.filter("tag = 'metacontent' and kind = 'council'").groupBy("path").agg(F.min_by("text", "pos").alias("council"))
    return e.filter("parent is null and tag is not null").join(council, "path", "left").select("path", "id", "title", "year", "council")


def sections(e: DataFrame) -> DataFrame:
    """(path, id, number, title, part): the parts, and the clauses of parts 4 and 5."""
    found = e.filter((F.col("tag") == "level") & (((F.col("kind") == "part") & F.col("id").rlike(r"^pt\.\d+$")) | ((F.col("kind") == "clause") & F.col("id").rlike(r"^sec\.[45]\.[0-9A-Z]+$"))))
    return found.filter("heading != ''").select("path", "id", "number", F.col("heading").alias("title"), F.regexp_extract("id", r"^(?:pt|sec)\.(\d+)", 1).cast("int").alias("part"))


def _subclauses(e: DataFrame) -> DataFrame:
    """The tiers in force right below a clause, with the clause's id, that are more than an objective."""
    heads = e.filter("tag = 'level' and kind = 'clause'").select("path", F.col("pos").alias("clause"), F.col("id").alias("clause_id"))
    tiers = e.filter("tag = 'tier' and coalesce(status, '') != 'repealed' and block is not null").join(heads, ["path", "clause"])
    return tiers.filter(F.col("id").rlike(r"^.*-ssec\.[^-]+$") & (F.regexp_replace("id", r"-ssec\.[^-]+$", "") == F.col("clause_id")))


_OBJECTIVES = r"(?i)^the objectives? of this clause"


def requirement_tree(e: DataFrame, parts: str = r"^sec\.[45]\.[0-9A-Z]+$") -> DataFrame:
    """(path, id, parent_id, clause_id, section_id, description, value, unit, qualifier, clause): what the clauses of parts 4 and 5 ask for.

    A clause is a requirement without a measure. In part 4 its subclauses and all items of their lists, at any depth, are below it,
    each with the measure in its text. In part 5 the items right below a subclause are, led in by its text, and where a
    clause has a list of its own, the items of that at any depth. Of equal ids the first counts. Objectives, repealed and
    not adopted text are left out, and clause 5.4, which has rows of its own (controls).
    """
    none = lambda kind: F.lit(None).cast(kind)
    heads = e.filter(F.col("id").rlike(parts) & (F.col("id") != "sec.5.4")).filter("tag = 'level' and kind = 'clause' and coalesce(status, '') != 'repealed' and heading != ''")
    heads = heads.filter(~F.coalesce("lead", F.lit("")).rlike(r"(?i)^\[not adopted\]"))
    top = heads.select("path", "pos", "id", none("string").alias("parent"), F.coalesce("number", F.regexp_replace("id", r"^sec\.", "")).alias("clause_id"), F.col("heading").alias("description"), none("string").alias("_said"), F.col("pos").alias("clause"))
    of = heads.select("path", F.col("pos").alias("clause"), F.col("id").alias("_clause"), F.col("id").startswith("sec.4.").alias("_deep"))
    tiers = _subclauses(e).join(of, ["path", "clause"]).filter(~F.coalesce("lead", F.lit("")).rlike(_OBJECTIVES))
    long = tiers.filter("length(block) >= 10")
    below = long.filter("_deep").select("path", "pos", "id", F.col("_clause").alias("parent"), F.col("label").alias("clause_id"), F.col("block").alias("description"), F.col("block").alias("_said"), "clause")

    named = e.filter("tag in ('level', 'tier', 'li')").select("path", F.col("pos").alias("parent"), F.coalesce("id", F.lit("")).alias("_parent"), (F.col("tag") == "li").alias("_nested"))
    items = e.filter("tag = 'li' and block != ''").join(named, ["path", "parent"]).join(of, ["path", "clause"])
    items = items.withColumn("id", F.coalesce("id", F.concat("_parent", F.lit("-li"))))
    inside = items.join(tiers.select("path", F.col("pos").alias("tier"), F.col("lead").alias("_lead"), F.col("block").alias("_tier")), ["path", "tier"])
    deep = inside.filter("_deep and length(_tier) >= 10").select("path", "pos", "id", F.col("_parent").alias("parent"), F.col("label").alias("clause_id"), F.col("block").alias("description"), F.col("block").alias("_said"), "clause")
    led = F.trim(F.concat_ws(" ", F.nullif("_lead", F.lit("")), F.nullif("number", F.lit("")), "block"))
    flat = inside.filter("not _deep and not _nested").select("path", "pos", "id", F.col("_clause").alias("parent"), F.col("label").alias("clause_id"), led.alias("description"), none("string").alias("_said"), "clause")
    own = items.filter("not _deep and tier is null").filter(~F.coalesce("lead", "block").rlike(r"(?i)^\[not (?:adopted|applicable)\]"))
    own = own.select("path", "pos", "id", F.col("_parent").alias("parent"), F.col("label").alias("clause_id"), F.col("block").alias("description"), F.col("block").alias("_said"), "clause")

    every = reduce(DataFrame.unionByName, [top, below, deep, flat, own])
    first = first_by(every, ["path", "id"], [F.col("pos")])
    top_unit = F.when(F.col("parent").isNull(), "map-reference")
    measured = first.withColumn("_m", metric(F.coalesce("_said", F.lit(""))))
    return measured.select("path", F.concat(F.lit("req:"), "id").alias("id"), F.concat(F.lit("req:"), "parent").alias("parent_id"), "clause_id", F.col("id").alias("section_id"), "description", "_m.value", F.coalesce("_m.unit", top_unit).alias("unit"), "_m.qualifier", "clause")


def controls(e: DataFrame) -> DataFrame:
    """(path, id, clause_id, use_slug, description, value, unit, qualifier, zones): the subclauses of 5.4, each for the use that its heading names."""
    tiers = e.filter(F.col("id").startswith("sec.5.4-ssec.")).filter("tag = 'tier' and coalesce(status, '') != 'repealed' and heading != '' and lead != ''")
    tiers = tiers.filter(~F.col("lead").rlike(r"(?i)^\[not adopted\]"))
    sqm = F.try_element_at(numbers(F.col("lead"), r"([\d,]+)\s*(?:square metres?)"), F.lit(1))
    rooms = F.nullif(F.regexp_extract("lead", r"(?i)no more than (\d+)\s*bedrooms?", 1), F.lit("")).cast("double")
    unit = F.when(sqm.isNotNull(), "sqm").when(rooms.isNotNull(), "bedrooms")
    clause = F.concat(F.regexp_replace(F.regexp_replace("id", r"^sec\.", ""), r"-ssec\.", "("), F.lit(")"))
    known = zones(e).groupBy("path").agg(F.collect_set("code").alias("_codes"))
    named = F.array_intersect(zone_mentions(F.col("lead")), F.coalesce("_codes", F.array().cast("array<string>")))
    return tiers.join(known, "path", "left").select("path", F.concat(F.lit("req:"), "id").alias("id"), clause.alias("clause_id"), slug(F.col("heading")).alias("use_slug"), F.col("lead").alias("description"), F.coalesce(sqm, rooms).alias("value"), unit.alias("unit"), F.lit("max").alias("qualifier"), named.alias("zones"))


def requirement_zones(tree: DataFrame, e: DataFrame) -> DataFrame:
    """(path, id, zone): the known zones that a requirement's clause names, or all of the document's where it names none."""
    known = zones(e).groupBy("path").agg(F.array_sort(F.collect_set("code")).alias("_codes"))
    named = e.filter("tag = 'level' and kind = 'clause'").join(known, "path").withColumn("_named", F.array_intersect(zone_mentions(F.col("whole")), "_codes"))
    per = named.select("path", F.col("pos").alias("clause"), F.when(F.size("_named") > 0, F.col("_named")).otherwise(F.col("_codes")).alias("_zones"))
    return tree.join(per, ["path", "clause"]).select("path", "id", F.explode("_zones").alias("zone"))


def requirement_uses(tree: DataFrame, e: DataFrame) -> DataFrame:
    """(path, id, use_slug): the uses of the document's zone tables that a requirement's text names, also in singular or plural.

    Both sides meet on the first three characters of a use, which no ending changes.
    """
    uses = zoned_terms(e).select("path", F.col("term").alias("_term"), F.col("slug").alias("use_slug"))
    whole = e.filter("tag = 'level' and kind = 'clause'").select("path", F.col("pos").alias("clause"), "whole")
    texts = tree.join(whole, ["path", "clause"]).select("path", "id", F.lower(F.when(F.col("parent_id").isNull(), F.col("whole")).otherwise(F.col("description"))).alias("_text"))
    starts = F.sequence(F.lit(1), F.greatest(F.char_length("_text"), F.lit(1)))
    # ids and keys alone go through the explode; the texts come back for the test
    keyed = texts.select("path", "id", F.explode(F.array_distinct(F.transform(starts, lambda i: F.substring(F.col("_text"), i, F.lit(3))))).alias("_key"))
    met = keyed.join(uses.withColumn("_key", F.substring("_term", 1, 3)), ["path", "_key"]).select("path", "id", "_term", "use_slug").distinct().join(texts, ["path", "id"])
    return met.filter(plural_hit(F.col("_term"), F.col("_text"))).select("path", "id", "use_slug").distinct()


def prerequisites(e: DataFrame) -> DataFrame:
    """(path, kind, pos, text): the subclauses of 3.1 (exempt) and 3.2 (complying), and the areas that 3.3 excludes."""
    said = _subclauses(e).filter(F.col("clause_id").isin("sec.3.1", "sec.3.2")).filter((F.col("block") != "") & ~F.col("block").rlike("(?i)^the objective"))
    said = said.select("path", F.when(F.col("clause_id") == "sec.3.1", "exempt").otherwise("complying").alias("kind"), "pos", F.col("block").alias("text"))
    return said.unionByName(exclusion_areas(e).select("path", F.lit("excluded").alias("kind"), "pos", "text"))


def exclusion_areas(e: DataFrame) -> DataFrame:
    """(path, pos, letter, text, refs): the areas listed in 3.3(2), with the clauses that they refer to."""
    tier = e.filter("tag = 'tier' and id = 'sec.3.3-ssec.2'").select("path", F.col("pos").alias("parent"))
    items = e.filter("tag = 'li'").join(tier, ["path", "parent"])
    letter = F.trim(F.regexp_replace("number", r"[()]", ""))
    text = F.trim(F.regexp_replace("whole", r"^\([^)]*\)\s*", ""))
    return items.select("path", "pos", letter.alias("letter"), text.alias("text"), clause_refs(text).alias("refs")).filter("letter != '' and text != ''")


def schedule_items(e: DataFrame) -> DataFrame:
    """(path, id, heading, consent, zones, conditions): schedule 2's clauses (exempt) and those of schedule 3, part 1 (complying).

    zones: the known zones that the conditions name; a clause without conditions in force is left out.
    """
    consent = F.when(F.col("within").contains("/sch.2/") | F.col("within").endswith("/sch.2"), "exempt").when(F.col("within").contains("/sch.3-pt.1"), "complying")
    heads = e.filter("tag = 'level' and kind = 'clause' and coalesce(status, '') != 'repealed' and heading != ''").withColumn("consent", consent).filter("consent is not null")
    said = _subclauses(e).filter("block != ''").groupBy("path", "clause").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]).alias("conditions"))
    known = zones(e).groupBy("path").agg(F.collect_set("code").alias("_codes"))
    out = heads.drop("clause").withColumnRenamed("pos", "clause").join(said, ["path", "clause"]).join(known, "path", "left")
    named = F.array_intersect(zone_mentions(F.array_join("conditions", " ")), F.coalesce("_codes", F.array().cast("array<string>")))
    return out.select("path", "id", "heading", "consent", named.alias("zones"), "conditions")


def additional_uses(e: DataFrame) -> DataFrame:
    """(path, id, heading, address, lots, permitted, use_slugs): schedule 1's sites: where they are, and what is permitted there.

    The first subclause describes the land, the others grant uses; use_slugs are those that the dictionary or a zone table knows.
    """
    heads = e.filter("tag = 'level' and kind = 'clause' and heading != ''").filter(F.col("id").startswith("sch.1-sec."))
    tiers = e.filter("tag = 'tier'").filter(F.col("id").rlike(r"^sch\.1-sec\.[^-]+-ssec\.[^-]+$")).select("path", "clause", "pos", "whole")
    said = tiers.groupBy("path", "clause").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "whole"))), lambda x: x["whole"]).alias("_t")).filter("size(_t) >= 2")
    rows = heads.drop("clause").withColumnRenamed("pos", "clause").join(said, ["path", "clause"])
    grant = F.array_join(F.slice("_t", 2, F.size("_t")), " ")
    for_what = F.regexp_extract_all(grant, F.lit(r"(?i)purposes of (?:an? )?([a-z][a-z ,/()&-]+?)(?:\s+is permitted|\s+are permitted|,\s+vehicle|\s*\.|$)"), 1)
    slugs = F.array_distinct(F.transform(F.flatten(F.transform(for_what, lambda x: F.split(x, r"\s*,\s*(?:and\s+)?"))), lambda x: slug(F.trim(x))))
    known = definitions(e).select("path", "slug").unionByName(land_uses(e).select("path", "slug")).groupBy("path").agg(F.collect_set("slug").alias("_known"))
    rows = rows.join(known, "path", "left")
    lots = F.regexp_extract(F.col("_t")[0], r"(?i)(Lots?\s[\d\sand]+,\s*DP\s*\d+)", 1)
    return rows.select("path", "id", "heading", F.trim(F.regexp_replace("heading", r"(?i)^use of certain land at\s+", "")).alias("address"), lots.alias("lots"), grant.alias("permitted"), F.array_intersect(slugs, F.coalesce("_known", F.array().cast("array<string>"))).alias("use_slugs"))


def local_provisions(e: DataFrame) -> DataFrame:
    """(path, id, number, title, summary): part 6's clauses in force, summed up by their first subclause that is no objective."""
    heads = e.filter("tag = 'level' and kind = 'clause' and coalesce(status, '') != 'repealed' and heading != ''").filter(F.col("id").rlike(r"^sec\.6\.[0-9A-Z]+$") & F.col("within").contains("/pt.6"))
    tiers = e.filter("tag = 'tier' and whole != ''").filter(F.col("id").rlike(r"^sec\.6\.[0-9A-Z]+-ssec\.[^-]+$"))
    told = tiers.filter(~F.regexp_replace("whole", r"^\([^)]*\)\s*", "").rlike(_OBJECTIVES)).groupBy("path", "clause").agg(F.min_by("whole", "pos").alias("summary"))
    rows = heads.drop("clause").withColumnRenamed("pos", "clause").join(told, ["path", "clause"], "left")
    return rows.select("path", "id", "number", F.col("heading").alias("title"), F.coalesce("summary", F.lit("")).alias("summary"))


def markdown_sections(e: DataFrame, least: int = 30) -> DataFrame:
    """(path, pos, title, body): a document's levels as the sections of a Markdown text; bodies of up to `least` characters stay out."""
    levels = e.filter("tag = 'level' and coalesce(status, '') != 'repealed' and heading != ''")
    title = F.concat(F.concat_ws(" ", F.nullif("number", F.lit("")), "heading"), F.coalesce(F.concat(F.lit(" ["), "id", F.lit("]")), F.lit("")))
    tiers = e.filter("tag = 'tier' and coalesce(status, '') != 'repealed' and block != ''").select("path", F.col("parent").alias("pos"), F.struct(F.col("pos").alias("p"), F.concat_ws(" ", "number", "block").alias("t")).alias("x"))
    said = tiers.groupBy("path", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n\n").alias("_below"))
    body = F.concat_ws("\n\n", F.nullif("block", F.lit("")), "_below")
    rows = levels.join(said, ["path", "pos"], "left").select("path", "pos", title.alias("title"), body.alias("body"))
    return rows.withColumn("body", F.when(F.length("body") > least, F.col("body")).otherwise(""))


def extract(files: DataFrame) -> dict[str, DataFrame]:
    """All tables of documents (path, xml) by name: what each operator of this module finds, and the errors of documents that can't be parsed.

    The documents are parsed once, into a written table that all others read.
    """
    e = written(elements(files), "elements")
    (nodes, edges), tree = structure(e), requirement_tree(e)
    return {
        "errors": e.filter("error IS NOT NULL").select("path", "error"), "plans": plan_info(e), "sections": sections(e), "zones": zones(e), "land_uses": land_uses(e), "terms": zoned_terms(e), "definitions": definitions(e),
        "nodes": nodes, "edges": edges, "requirements": tree, "requirement_zones": requirement_zones(tree, e), "requirement_uses": requirement_uses(tree, e), "controls": controls(e), "prerequisites": prerequisites(e), "exclusions": exclusion_areas(e),
        "schedule_items": schedule_items(e), "sites": additional_uses(e), "heritage": heritage_items(e), "local_provisions": local_provisions(e), "zone_index": zone_index(e), "lot_sizes": lot_size_index(e), "markdown": markdown_sections(e),
    }


def site_lots(text):
    """Lot and plan references of a site's text, as `Lot 9, DP 862908` or `Lots 7300 and 7301, DP 1153423`."""
    return F.regexp_extract_all(text, F.lit(r"(Lots? [\dA-Z]+(?:(?:, | and )[\dA-Z]+)*, (?:DP|SP) \d+)"), 1)
