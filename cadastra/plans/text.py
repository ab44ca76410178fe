"""Text rules over documents, pages and parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadastra.functions.text import clause_refs, html_clean, html_escape, intent_keywords, markdown_html, metric, numbers, rolling_hash, route, slug, slug_file, slug_heading, zone_family, zone_mentions
from cadastra.functions.text import HECTARES, METRES, PERCENT, SQUARE_METRES
from cadastra.plans.registry import query
from cadastra.sources.tables import table


@query(r"SELECT page_id, nullif(regexp_extract(html, '<title>(.*?)</title>', 1), '') AS title FROM pages")
def src_title_index(spark, d):
    return table(spark, d, "pages").select("page_id", F.nullif(F.regexp_extract("html", "<title>(.*?)</title>", 1), F.lit("")).alias("title"))


@query(r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script.*?</script>', ' ', 'g'), '(?is)<style.*?</style>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '<[^>]*>', ' ', 'g') AS t FROM pages),
           b AS (SELECT page_id, replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&') AS t FROM a)
           SELECT page_id, trim(regexp_replace(t, '[ \t\n\r\f]+', ' ', 'g')) AS body FROM b""", name="html_clean")
def html_clean_pages(spark, d):
    return table(spark, d, "pages").select("page_id", html_clean(F.col("html")).alias("body"))


@query("""SELECT page_id, md5(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped FROM pages""", name="html_escape")
def html_escape_pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(html_escape(F.col("html"))).alias("escaped"))


# Documents with a clause behind the text, of four kinds by doc_id: land sizes, distances, shares, and none at all.
_CLAUSE = """text || CASE doc_id % 4 WHEN 0 THEN ' Land in Zone R' || (doc_id % 6) || ' and Zone RU' || (doc_id % 3) || ' or Zone R' || (doc_id % 6) || ', clause 4.' || (doc_id % 90) || 'A or clause ' || doc_id || ': not less than ' || (doc_id % 70) || ',500 square metres, 1,200 m2 or ' || (doc_id % 9) || '.5 ha'
  WHEN 1 THEN ' A setback in Zone E' || (doc_id % 4) || ' of not more than ' || (doc_id % 30) || '.5 metres, clause 5.' || (doc_id % 40) WHEN 2 THEN ' At most ' || (doc_id % 100) || '% of Zone Objectives or ' || (doc_id % 50) || ' per cent' WHEN 3 THEN CASE doc_id % 8 WHEN 3 THEN ' A sign of 1 square metre' ELSE ' A fence of 0.9 metre or on 1 hectare' END END"""
# The measures again, for SQL: a number, then its unit, in the singular or not.
_SQL_NUMBER = r"([0-9][0-9,]*(?:[.][0-9]+)?)\s*"
_SQL_SQM, _SQL_HA, _SQL_M, _SQL_SHARE = _SQL_NUMBER + "(?:square metres|square metre|sqm|m2|m²)", _SQL_NUMBER + r"(?:ha|hectare|hectares)\b", _SQL_NUMBER + r"(?:m|metre|metres)\b", _SQL_NUMBER + "(?:per cent|%)"
_BODY = f"t AS (SELECT doc_id, {_CLAUSE} AS text FROM documents)"
_ONCE = "list_filter({l}, lambda x, i: list_position({l}, x) = i)"
_FAMILY = """CASE WHEN {z} LIKE 'RU%' THEN 'RU' WHEN regexp_matches({z}, '^R[0-9]') THEN 'R' WHEN {z} LIKE 'B%' THEN 'B' WHEN {z} LIKE 'MU%' THEN 'MU' WHEN {z} LIKE 'IN%' THEN 'IN'
  WHEN {z} LIKE 'SP%' THEN 'SP' WHEN {z} LIKE 'RE%' THEN 'RE' WHEN {z} LIKE 'C%' THEN 'C' WHEN {z} LIKE 'W%' THEN 'W' WHEN {z} LIKE 'E%' THEN 'E' ELSE 'OTHER' END"""
_FIRST = "try_cast(replace(nullif(regexp_extract(text, '{p}', 1), ''), ',', '') AS DOUBLE)"


def _clauses(spark, d):
    k = F.col("doc_id")
    land = F.format_string(" Land in Zone R%d and Zone RU%d or Zone R%d, clause 4.%dA or clause %d: not less than %d,500 square metres, 1,200 m2 or %d.5 ha", k % 6, k % 3, k % 6, k % 90, k, k % 70, k % 9)
    away = F.format_string(" A setback in Zone E%d of not more than %d.5 metres, clause 5.%d", k % 4, k % 30, k % 40)
    share = F.format_string(" At most %d%% of Zone Objectives or %d per cent", k % 100, k % 50)
    clause = F.when(k % 4 == 0, land).when(k % 4 == 1, away).when(k % 4 == 2, share).when(k % 8 == 3, " A sign of 1 square metre").otherwise(" A fence of 0.9 metre or on 1 hectare")
    return table(spark, d, "documents").select("doc_id", F.concat("text", clause).alias("text"))


@query(rf"""WITH {_BODY}, z AS (SELECT doc_id, regexp_extract_all(text, 'Zone\s+([A-Z][A-Z0-9]*)', 1) AS l FROM t) SELECT doc_id, array_to_string({_ONCE.format(l="l")}, ',') AS zones FROM z""", name="zone_mentions")
def zone_mention_codes(spark, d):
    return _clauses(spark, d).select("doc_id", F.array_join(zone_mentions(F.col("text")), ",").alias("zones"))


@query(rf"""WITH {_BODY}, z AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, 'Zone\s+([A-Z][A-Z0-9]*)', 1)) AS zone FROM t) SELECT doc_id, zone, {_FAMILY.format(z="zone")} AS family FROM z""")
def clause_zone_explode(spark, d):
    zones = _clauses(spark, d).select("doc_id", F.explode(zone_mentions(F.col("text"))).alias("zone"))
    return zones.withColumn("family", zone_family(F.col("zone")))


@query(rf"""WITH {_BODY}, r AS (SELECT doc_id, regexp_extract_all(text, 'clause\s+(\d+[A-Z]*(?:\.\d+[A-Z]*)*)', 1) AS l FROM t) SELECT doc_id, array_to_string({_ONCE.format(l="l")}, '|') AS refs FROM r""", name="clause_refs")
def clause_ref_numbers(spark, d):
    return _clauses(spark, d).select("doc_id", F.array_join(clause_refs(F.col("text")), "|").alias("refs"))


@query(rf"""WITH {_BODY}, m AS (SELECT doc_id, lower(text) AS low, {_FIRST.format(p=_SQL_SQM)} AS sqm, {_FIRST.format(p=_SQL_M)} AS m, {_FIRST.format(p=_SQL_SHARE)} AS share FROM t)
            SELECT doc_id, coalesce(sqm, m, share) AS value, CASE WHEN sqm IS NOT NULL THEN 'sqm' WHEN m IS NOT NULL THEN 'm' WHEN share IS NOT NULL THEN '%' END AS unit,
            CASE WHEN sqm IS NOT NULL OR (m IS NULL AND share IS NOT NULL) THEN CASE WHEN contains(low, 'not less than') THEN 'min' ELSE 'max' END
                 WHEN m IS NOT NULL THEN CASE WHEN contains(low, 'not more than') OR contains(low, 'exceed') THEN 'max' ELSE 'min' END END AS qualifier FROM m""")
def metric_extract(spark, d):
    return _clauses(spark, d).select("doc_id", metric(F.col("text")).alias("m")).select("doc_id", "m.*")


@query(rf"""WITH {_BODY}, s AS (SELECT *, list_distinct(list_transform(regexp_extract_all(text, '{_SQL_SQM}', 1), lambda x: replace(x, ',', '')::DOUBLE)) AS l FROM t)
            SELECT doc_id, len(l)::INT AS n_sqm, {_FIRST.format(p=_SQL_SQM)} AS sqm, {_FIRST.format(p=_SQL_HA)} AS ha, {_FIRST.format(p=_SQL_M)} AS m, {_FIRST.format(p=_SQL_SHARE)} AS percent FROM s""")
def metric_sets(spark, d):
    t = F.col("text")
    first = lambda p: F.try_element_at(numbers(t, p), F.lit(1))
    return _clauses(spark, d).select("doc_id", F.size(numbers(t, SQUARE_METRES)).alias("n_sqm"), first(SQUARE_METRES).alias("sqm"), first(HECTARES).alias("ha"), first(METRES).alias("m"), first(PERCENT).alias("percent"))


@query(r"""WITH l AS (SELECT p_brand, string_agg(DISTINCT p_type || ' ' || p_name, '; ' ORDER BY p_type || ' ' || p_name) || '; Any other development not specified' AS txt FROM part GROUP BY p_brand),
           u AS (SELECT p_brand, trim(unnest(regexp_split_to_array(txt, ';\s*'))) AS use FROM l) SELECT p_brand, use, regexp_matches(use, '^Any other development') AS catch_all FROM u WHERE use <> ''""")
def landuse_split(spark, d):
    uses = F.array_sort(F.collect_set(F.concat_ws(" ", "p_type", "p_name")))
    lists = table(spark, d, "part").groupBy("p_brand").agg(F.concat(F.array_join(uses, "; "), F.lit("; Any other development not specified")).alias("txt"))
    split = lists.select("p_brand", F.explode(F.split("txt", r";\s*")).alias("use")).withColumn("use", F.trim("use")).filter("use != ''")
    return split.withColumn("catch_all", F.col("use").rlike("^Any other development"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug, left(regexp_replace(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 80) AS file, left(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), 30) AS heading FROM documents")
def slugify(spark, d):
    text = F.col("text")
    return table(spark, d, "documents").select("doc_id", F.md5(slug(text)).alias("slug"), slug_file(text).alias("file"), slug_heading(text).alias("heading"))


@query("""WITH z AS (SELECT p_partkey, CASE p_size % 11 WHEN 0 THEN 'RU' WHEN 1 THEN 'R' WHEN 2 THEN 'B' WHEN 3 THEN 'MU' WHEN 4 THEN 'IN' WHEN 5 THEN 'SP' WHEN 6 THEN 'RE' WHEN 7 THEN 'C' WHEN 8 THEN 'W' WHEN 9 THEN 'E' ELSE 'DM' END || (p_size % 4) AS zone FROM part)
          SELECT p_partkey, zone, """ + _FAMILY.format(z="zone") + " AS family FROM z", name="zone_family")
def zone_families(spark, d):
    codes = F.array(*[F.lit(x) for x in ("RU", "R", "B", "MU", "IN", "SP", "RE", "C", "W", "E", "DM")])
    zone = F.concat(F.element_at(codes, F.col("p_size") % 11 + 1), (F.col("p_size") % 4).cast("string"))
    return table(spark, d, "part").select("p_partkey", zone.alias("zone")).withColumn("family", zone_family(F.col("zone")))


@query("""WITH h AS (SELECT p_partkey, list_reduce(list_transform(string_split(p_name || p_type, ''), lambda c: unicode(c)::BIGINT), lambda h, c: (h * 31 + c) % 4294967296, 0::BIGINT) AS h FROM part)
          SELECT p_partkey, CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS h FROM h""", name="rolling_hash")
def rolling_hashes(spark, d):
    return table(spark, d, "part").select("p_partkey", rolling_hash(F.concat("p_name", "p_type")).alias("h"))


@query(r"SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 3)[1:6], ' ') AS keywords FROM documents")
def intent_fallback(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(intent_keywords(F.col("text")), " ").alias("keywords"))


def toc(docs, key: str, body: str):
    """(key, pos, level, heading) of a Markdown text's headings of the first three levels, without [ids] at their ends."""
    lines = docs.select(key, F.posexplode(F.split(body, "\n")).alias("pos", "line")).filter(F.col("line").rlike(r"^#{1,3}\s"))
    heading = F.trim(F.regexp_replace(F.regexp_replace("line", r"^#+\s*", ""), r"\s*\[.*\]\s*$", ""))
    return lines.select(key, F.col("pos").cast("long").alias("pos"), F.length(F.regexp_extract("line", "^#+", 0)).alias("level"), heading.alias("heading"))


@query(r"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
           h AS (SELECT doc_id, pos, repeat('#', (1 + length(line) % 4)::INT) || ' ' || line || ' [s' || pos || ']' AS line FROM l)
           SELECT doc_id, pos, length(regexp_extract(line, '^#+', 0))::INT AS level, trim(regexp_replace(regexp_replace(line, '^#+\s*', ''), '\s*\[.*\]\s*$', '')) AS heading FROM h WHERE regexp_matches(line, '^#{1,3}\s')""")
def toc_extract(spark, d):
    lines = F.transform(F.split("text", "\n"), lambda x, i: F.concat(F.repeat(F.lit("#"), 1 + F.length(x) % 4), F.lit(" "), x, F.lit(" [s"), i.cast("string"), F.lit("]")))
    return toc(table(spark, d, "documents").select("doc_id", F.array_join(lines, "\n").alias("body")), "doc_id", "body")


@query(r"""WITH l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
           i AS (SELECT doc_id, pos, CASE WHEN regexp_matches(line, '^([A-Z]?\d+(?:\.\d+)*[A-Z]?)\s+(.+)$') THEN 'dcp.' || regexp_extract(line, '^([A-Z]?\d+(?:\.\d+)*[A-Z]?)\s+(.+)$', 1) ELSE 'dcp.h2.' || left(regexp_replace(lower(line), '[^a-z0-9]+', '_', 'g'), 30) END AS id FROM l),
           n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, id ORDER BY pos) AS r FROM i) SELECT doc_id, pos, id || CASE WHEN r > 1 THEN '#' || r ELSE '' END AS id FROM n""")
def heading_ids(spark, d):
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    number = F.regexp_extract("line", r"^([A-Z]?\d+(?:\.\d+)*[A-Z]?)\s+(.+)$", 1)
    ids = lines.select("doc_id", F.col("pos").cast("long").alias("pos"), F.when(number != "", F.concat(F.lit("dcp."), number)).otherwise(F.concat(F.lit("dcp.h2."), slug_heading(F.col("line")))).alias("id"))
    n = F.row_number().over(Window.partitionBy("doc_id", "id").orderBy("pos"))
    return ids.withColumn("n", n).select("doc_id", "pos", F.concat("id", F.when(F.col("n") > 1, F.concat(F.lit("#"), F.col("n").cast("string"))).otherwise("")).alias("id"))


def sections(answers, key: str, body: str):
    """lep, sepp and dcp: what follows each `## X Findings` heading up to the next."""
    part = lambda x: F.trim(F.regexp_extract(body, rf"(?s)## {x} Findings?\n(.*?)(?=\n## (?:LEP|SEPP|DCP) Findings?\n|$)", 1))
    return answers.select(key, *[part(x).alias(x.lower()) for x in ("LEP", "SEPP", "DCP")])


@query("SELECT item_id, trim(left(text, 40)) AS lep, trim(text[41:80]) AS sepp, trim(text[81:]) AS dcp FROM benchmark")
def section_split(spark, d):
    part = lambda a, n: F.substring("text", a, n)
    body = F.concat(F.lit("## LEP Findings\n"), part(1, 40), F.lit("\n## SEPP Findings\n"), part(41, 40), F.lit("\n## DCP Finding\n"), part(81, 1 << 30))
    return sections(table(spark, d, "benchmark").select("item_id", body.alias("body")), "item_id", "body")


_QUESTION = "CASE turn % 5 WHEN 0 THEN 'Can I build a pool here? ' WHEN 1 THEN 'What is the setback? ' WHEN 2 THEN 'As you said above ' WHEN 3 THEN 'Tell me about complying development ' ELSE '' END || text"


@query(f"""WITH q AS (SELECT conv_id, turn, {_QUESTION} AS q, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS prev FROM conversations)
           SELECT conv_id, turn, CASE WHEN prev <> '' AND turn % 5 = 2 THEN 'context_only' WHEN turn % 5 = 0 THEN 'use_check' WHEN turn % 5 = 1 THEN 'context_only' WHEN turn % 5 = 3 THEN 'cdc_sepp'
           WHEN regexp_matches(q, '(?i)\\b(pos|bin|waste|pool|deck|design|fence|parking)\\b') THEN 'dcp_controls' ELSE 'new_lookup' END AS route FROM q""")
def route_classify(spark, d):
    k = F.col("turn") % 5
    q = F.concat(F.when(k == 0, "Can I build a pool here? ").when(k == 1, "What is the setback? ").when(k == 2, "As you said above ").when(k == 3, "Tell me about complying development ").otherwise(""), "text")
    before = F.lag("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", q.alias("q"), before.alias("prev")).select("conv_id", "turn", route(F.col("q"), F.col("prev")).alias("route"))


_MARKED = "'## Answer ' || doc_id || chr(10) || '### Why' || chr(10) || chr(10) || '**Bold** and `code` in ' || text || chr(10) || chr(10) || chr(10) || '- first <b>' || chr(10) || '* second & last' || chr(10) || chr(10) || '**Sources:** none' || chr(10) || 'tail'"


@query(rf"""WITH m AS (SELECT doc_id, {_MARKED} AS t FROM documents), a AS (SELECT doc_id, rtrim(t[1:length(t) - length(chr(10) || chr(10) || '**Sources:** none' || chr(10) || 'tail')], ' ') AS t FROM m),
            e AS (SELECT doc_id, replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS t FROM a),
            h AS (SELECT doc_id, replace(regexp_replace(regexp_replace(t, '(?m)^[ \t]*#{{3,6}}[ \t]+(.+?)[ \t]*$', '<div class="heading-small">\1</div>', 'g'), '(?m)^[ \t]*#{{1,2}}[ \t]+(.+?)[ \t]*$', '<div class="heading">\1</div>', 'g'), 'Why</div>' || chr(10) || chr(10), 'Why</div>' || chr(10)) AS t FROM e),
            b AS (SELECT doc_id, regexp_replace(regexp_replace(t, '\*\*([^*]+)\*\*', '<strong>\1</strong>', 'g'), '`([^`]+)`', '<code>\1</code>', 'g') AS t FROM h),
            l AS (SELECT doc_id, regexp_replace(t, '(?m)^[-*][ \t]+(.+)$', '<ul><li>\1</li></ul>', 'g') AS t FROM b)
            SELECT doc_id, md5('<p>' || regexp_replace(t, '\n\n+', '</p><p>', 'g') || '</p>') AS html FROM l""")
def answer_html(spark, d):
    """Documents with headings, bold and code, a list and a tail of sources around them."""
    n = lambda x: F.lit(x)
    text = F.concat(n("## Answer "), F.col("doc_id").cast("string"), n("\n### Why\n\n**Bold** and `code` in "), F.col("text"), n("\n\n\n- first <b>\n* second & last\n\n**Sources:** none\ntail"))
    return table(spark, d, "documents").select("doc_id", F.md5(markdown_html(text)).alias("html"))
