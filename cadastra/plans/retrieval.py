"""Hybrid retrieval, graph expansion, precedence and citations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cadastra.functions.text import CITATION, document_label, intent_keywords, quote, section_label
from cadastra.functions.vectors import cosine
from cadastra.operators.full_text import add_documents, index_search, with_stems
from cadastra.operators.precedence import decisions
from cadastra.operators.precedence import precedence as ranked_precedence
from cadastra.operators.reports import proposition_text
from cadastra.operators.retrieval import batch_vector_search, context_block, expand, fuse, overrides_block, precedence_kept, precedence_pairs, vector_search
from cadastra.operators.vector_index import build_index, search_index
from cadastra.plans.registry import query
from cadastra.plans.stems_sql import STEMS_SQL
from cadastra.sources.tables import shared_path, table

#: What the text queries ask for: stop words, a plural, and a word with an ending.
ASKED = "the erings of ones"
_DOT = "list_dot_product({a}::DOUBLE[], {b}::DOUBLE[])"
_Q = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
_COS = "1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q)))"
_VEC = f"""v AS (SELECT vec_id AS id, round({_COS}, 6) + 0.0 AS vector_distance FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), {_Q} ORDER BY vector_distance, id LIMIT 50),
           vr AS (SELECT *, row_number() OVER (ORDER BY vector_distance, id)::INT AS vector_rank FROM v)"""
_TXT = f"""{STEMS_SQL}, q AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents),
           m AS (SELECT id, pos, stem FROM (SELECT id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM q) JOIN stems USING (word) WHERE stem IN ('ere', 'one')),
           -- at each place the last one of either stem: the shortest stretch that ends here
           l AS (SELECT *, row_number() OVER d AS n, max(CASE WHEN stem = 'ere' THEN pos END) OVER d AS a, max(CASE WHEN stem = 'one' THEN pos END) OVER d AS b FROM m WINDOW d AS (PARTITION BY id ORDER BY pos)),
           s AS (SELECT *, least(a, b) AS begun, lag(least(a, b)) OVER (PARTITION BY id ORDER BY pos) AS before FROM l WHERE a IS NOT NULL AND b IS NOT NULL),
           t AS (SELECT s.id, round(sum(0.1::DOUBLE / (1 + (s.pos - s.begun) - (s.n - f.n))), 6) AS text_score FROM s JOIN l f ON f.id = s.id AND f.pos = s.begun WHERE before IS NULL OR begun > before
                 GROUP BY s.id ORDER BY text_score DESC, s.id LIMIT 50),
           tr AS (SELECT *, row_number() OVER (ORDER BY text_score DESC, id)::INT AS text_rank FROM t)"""
_RRF = f"""{_VEC}, {_TXT}, f AS (SELECT coalesce(vr.id, tr.id) AS id, vector_rank, text_rank, round(coalesce(1.0::DOUBLE / (60 + vector_rank), 0) + coalesce(1.0::DOUBLE / (60 + text_rank), 0), 9) AS rrf_score
           FROM vr FULL JOIN tr ON vr.id = tr.id ORDER BY rrf_score DESC, vector_rank NULLS LAST, text_rank NULLS LAST, id LIMIT 30)"""


def _query_vector(spark, d):
    return table(spark, d, "embeddings").filter("vec_id = 0").first()["embedding"]


def _vectors(spark, d):
    return vector_search(table(spark, d, "embeddings"), _query_vector(spark, d), id_col="vec_id")


_INDEXES: dict[tuple[str, str], str] = {}


def _index(spark, d) -> str:
    """The text index over the documents of these tables, made once in a session."""
    at = spark.sparkContext.applicationId, d
    if at not in _INDEXES:
        path = shared_path(spark, "text-index")
        add_documents(table(spark, d, "documents"), path, id_col="doc_id")
        _INDEXES[at] = path
    return _INDEXES[at]


def _texts(spark, d):
    return index_search(spark, _index(spark, d), ASKED)


@query(f"WITH {_VEC} SELECT * FROM vr")
def vec_topk(spark, d):
    return _vectors(spark, d)


@query(f"SELECT vec_id, round(1 - ({_COS}), 6) AS similarity FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), {_Q}")
def vec_cosine(spark, d):
    q = F.array(*[F.lit(float(x)) for x in _query_vector(spark, d)])
    return table(spark, d, "embeddings").select("vec_id", F.round(cosine(F.col("embedding"), q), 6).alias("similarity"))


@query(f"WITH {_TXT} SELECT * FROM tr")
def fts_rank(spark, d):
    return _texts(spark, d)


@query(f"WITH {STEMS_SQL} SELECT word, stem FROM stems")
def stem_words(spark, d):
    """The words of all documents with their stems."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))).alias("word")
    return with_stems(table(spark, d, "documents").select(words).distinct())


@query(f"WITH {_RRF} SELECT * FROM f")
def rrf_fusion(spark, d):
    return fuse(_vectors(spark, d), _texts(spark, d))


_NEAREST = """WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 100 = 0), x AS (SELECT query_id, vec_id AS id,
          round(1 - list_dot_product(e, q) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(q, q))), 6) + 0.0 AS distance FROM q, (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)),
          r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, id)::INT AS rank FROM x) SELECT * FROM r WHERE rank <= 10"""


def _asked_vectors(spark, d):
    return table(spark, d, "embeddings").filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


@query(_NEAREST)
def multi_query_batch(spark, d):
    return batch_vector_search(table(spark, d, "embeddings"), _asked_vectors(spark, d), 10, id_col="vec_id")


def _vector_index(spark, d) -> str:
    """The inverted lists over the vectors of these tables, made once in a session."""
    at = spark.sparkContext.applicationId, f"{d} vectors"
    if at not in _INDEXES:
        path = shared_path(spark, "vector-index")
        build_index(table(spark, d, "embeddings"), path, id_col="vec_id")
        _INDEXES[at] = path
    return _INDEXES[at]


@query()
def vec_index(spark, d):
    """Approximate: the share of the exact answers that it finds is tested, as no SQL gives its rows."""
    return search_index(spark, _vector_index(spark, d), _asked_vectors(spark, d))


@query(_NEAREST)
def vec_index_certain(spark, d):
    """Few lists first, then those that may hold something nearer."""
    return search_index(spark, _vector_index(spark, d), _asked_vectors(spark, d), probes=4, certain=True)


def _edges(spark, d):
    """Parts, suppliers and orders as nodes: parts define suppliers, suppliers require orders, nations constrain suppliers."""
    lines = table(spark, d, "lineitem")

    def edge(df, kind, a, from_key, b, to_key):
        return df.select(F.lit(kind).alias("type"), F.lit(a).alias("from_kind"), F.col(from_key).cast("long").alias("from_key"), F.lit(b).alias("to_kind"), F.col(to_key).cast("long").alias("to_key"))

    e = edge(lines, "defines", "p", "l_partkey", "s", "l_suppkey").unionByName(edge(lines, "requires", "s", "l_suppkey", "o", "l_orderkey"))
    return e.unionByName(edge(table(spark, d, "supplier"), "constrains", "n", "s_nationkey", "s", "s_suppkey"))


_EXPAND = """e AS (SELECT 'p' || l_partkey AS id, 1 AS o FROM lineitem WHERE l_suppkey IN (1, 2) UNION ALL SELECT 'o' || l_orderkey, 2 FROM lineitem WHERE l_suppkey IN (1, 2) UNION ALL SELECT 'n' || s_nationkey, 3 FROM supplier WHERE s_suppkey IN (1, 2)),
             f AS (SELECT id, min(o) AS o FROM e GROUP BY id ORDER BY o, id LIMIT 30)"""


def _expanded(spark, d):
    seeds = spark.createDataFrame([("s", 1), ("s", 2)], "kind string, key long")
    return expand(seeds, _edges(spark, d))


@query(f"WITH {_EXPAND} SELECT id, CASE o WHEN 1 THEN 'defines' WHEN 2 THEN 'requires' ELSE 'constrains' END AS expanded_via, row_number() OVER (ORDER BY o, id)::INT AS pos FROM f")
def graph_expand(spark, d):
    return _expanded(spark, d)


@query(f"WITH {_EXPAND}, a AS (SELECT left(id, 1) AS kind FROM f UNION ALL SELECT 's' FROM range(2)) SELECT kind, count(*) AS n FROM a GROUP BY kind")
def doc_type_counts(spark, d):
    found = _expanded(spark, d).select(F.substring("id", 1, 1).alias("kind"))
    return found.unionByName(spark.createDataFrame([("s",), ("s",)], "kind string")).groupBy("kind").agg(F.count("*").alias("n"))


def _propositions(spark, d):
    brand = F.col("p_brand")
    level = (F.regexp_extract(brand, r"(\d+)", 1).cast("int") % 4 + 1).alias("level")
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), brand.alias("document_id"), level, F.col("p_type").alias("type"), F.col("p_name").alias("subject"))


_PROP = r"p AS (SELECT p_partkey AS id, p_brand AS document_id, regexp_extract(p_brand, '(\d+)', 1)::INT % 4 + 1 AS level, p_type AS type, p_name AS subject FROM part)"


@query(f"""WITH {_PROP}, w AS (SELECT b.id AS loser_id, first(a.id ORDER BY a.level, a.id) AS winner_id FROM p a JOIN p b ON a.type = b.type AND a.subject = b.subject AND a.document_id <> b.document_id AND a.level < b.level GROUP BY b.id)
           SELECT winner_id, loser_id FROM w""")
def hierarchy_pairs(spark, d):
    return precedence_pairs(_propositions(spark, d))


_CANDIDATES = r"""c AS (SELECT p_partkey // 60 AS query_id, p_partkey % 60 AS pos, p_partkey AS id, p_brand AS document_id, regexp_extract(p_brand, '(\d+)', 1)::INT % 4 + 1 AS level, left(p_type, 1) AS type,
                  CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN split_part(p_name, ' ', 1) || '-' || split_part(p_name, ' ', 2) || ' plant' ELSE split_part(p_name, ' ', 2) END AS subject FROM part)"""


@query(f"""WITH RECURSIVE {_CANDIDATES}, s AS (SELECT *, trim(regexp_replace(regexp_replace(lower(subject), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS n FROM c),
           p AS (SELECT a.query_id, a.pos AS i, b.pos AS j, CASE WHEN a.level < b.level THEN b.pos ELSE a.pos END AS loser, row_number() OVER (PARTITION BY a.query_id ORDER BY a.pos, b.pos) AS k
                 FROM s a JOIN s b ON a.query_id = b.query_id AND a.pos < b.pos AND a.type = b.type AND a.document_id <> b.document_id AND a.level <> b.level
                 AND (a.n = b.n OR (length(a.n) >= 6 AND length(b.n) >= 6 AND (contains(a.n, b.n) OR contains(b.n, a.n))))),
           g AS (SELECT DISTINCT query_id, 0::BIGINT AS k, []::BIGINT[] AS gone, -1::BIGINT AS i, true AS goes FROM p
                 UNION ALL SELECT query_id, k, CASE WHEN now AND NOT list_contains(gone, j) THEN list_append(gone, loser) ELSE gone END, i, now
                 FROM (SELECT g.query_id, p.k, g.gone, p.i, p.j, p.loser, CASE WHEN p.i <> g.i THEN NOT list_contains(g.gone, p.i) ELSE g.goes END AS now FROM g JOIN p ON p.query_id = g.query_id AND p.k = g.k + 1)),
           e AS (SELECT query_id, arg_max(gone, k) AS gone FROM g GROUP BY query_id)
           SELECT c.query_id, c.id, NOT coalesce(list_contains(e.gone, c.pos), false) AS kept FROM c LEFT JOIN e USING (query_id)""")
def precedence(spark, d):
    """Candidates in turn, sixty a query; subjects match where one holds the other."""
    return ranked_precedence(_ranked_parts(spark, d)).select("query_id", "id", "kept")


@query()
def precedence_overrides(spark, d):
    """What was overridden by what, with the line that tells of it; tested against the comparison of all pairs."""
    told = decisions(ranked_precedence(_ranked_parts(spark, d)))
    return told.select("query_id", "loser_id", "winner_id", overrides_block(told).alias("line"))


def _ranked_parts(spark, d):
    name, k = F.col("p_name"), F.col("p_partkey")
    level = (F.regexp_extract("p_brand", r"(\d+)", 1).cast("int") % 4 + 1).alias("level")
    word = lambda i: F.split_part(name, F.lit(" "), F.lit(i))
    subject = F.when(k % 3 == 0, name).when(k % 3 == 1, F.concat(word(1), F.lit("-"), word(2), F.lit(" plant"))).otherwise(word(2))
    return table(spark, d, "part").select(F.expr("p_partkey div 60").alias("query_id"), (k % 60).alias("pos"), k.alias("id"), F.col("p_brand").alias("document_id"), level, F.substring("p_type", 1, 1).alias("type"), subject.alias("subject"))


@query(f"WITH {_PROP}, m AS (SELECT *, min(level) OVER (PARTITION BY type, subject) AS least FROM p) SELECT id, document_id, level, type, subject FROM m WHERE level = least")
def hierarchy_kept(spark, d):
    return precedence_kept(_propositions(spark, d))


@query(r"SELECT left(concat_ws(' ', text, nullif(array_to_string(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 3)[1:6], ' '), '')), 800) AS q, doc_id FROM documents")
def query_text(spark, d):
    words = F.nullif(F.array_join(intent_keywords(F.col("text")), " "), F.lit(""))
    return table(spark, d, "documents").select(F.substring(F.concat_ws(" ", "text", words), 1, 800).alias("q"), "doc_id")


@query("SELECT source, sum(ceil(length(text) / 4) + 30)::BIGINT AS tokens FROM documents GROUP BY source")
def token_estimate(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.sum(F.ceil(F.length("text") / 4) + 30).cast("long").alias("tokens"))


_CTX = f"""{_RRF}, c AS (SELECT f.id, 'retrieved' AS source, rrf_score, 'sec.' || f.id AS section, 'lep' AS doc_type, lang AS type, 'document' AS subject, 'says' AS predicate, text AS span FROM f JOIN documents ON f.id = doc_id),
           o AS (SELECT *, row_number() OVER (ORDER BY rrf_score DESC, id)::INT AS pos FROM c)"""


@query(f"""WITH {_CTX} SELECT pos, pos || '. [' || section || '] (' || upper(doc_type) || ' · ' || type || ')' || chr(10) || '   ' || subject || ' ' || predicate || chr(10) ||
           CASE WHEN length(span) < 240 THEN '   "' || span || '"' ELSE '   "' || left(span, 240) || '…"' END AS block FROM o""", name="context_block")
def context_blocks(spark, d):
    found = rrf_fusion(spark, d).join(table(spark, d, "documents"), F.col("id") == F.col("doc_id"))
    none = lambda kind: F.lit(None).cast(kind)
    rows = found.select(
        "id", F.lit("retrieved").alias("source"), "rrf_score", F.concat(F.lit("sec."), F.col("id").cast("string")).alias("section"), F.lit("lep").alias("doc_type"), F.col("lang").alias("type"),
        F.lit("document").alias("subject"), F.lit("says").alias("predicate"), none("string").alias("object"), none("double").alias("numeric_value"), none("string").alias("numeric_comparator"),
        none("string").alias("numeric_unit"), none("string").alias("value_source"), F.col("text").alias("source_span"),
    )
    return context_block(rows)


_ANSWER = "text || ' [sec.' || (turn + 1) || '.' || (conv_id % 5) || '-ssec.2] and [DCP.10.' || (conv_id % 3) || '] [sec.' || (turn + 1) || '.' || (conv_id % 5) || '-ssec.2] [zone.x]'"
_CITED = f"""a AS (SELECT conv_id, turn, {_ANSWER} AS answer FROM conversations), m AS (SELECT conv_id, turn, unnest(l) AS ref, generate_subscripts(l, 1) AS pos FROM
             (SELECT conv_id, turn, list_transform(regexp_extract_all(answer, '\\[((?:sec|cl|sch|pt|ch|dict)\\.[\\w.-]+(?:#\\d+)?|dcp\\.[\\w.#-]+)\\]', 1, 'i'), lambda x: lower(x)) AS l FROM a))"""


def cited(answers, key: list[str]):
    """(key, ref, pos): the section markers of an answer in order, lower-cased."""
    refs = F.transform(F.regexp_extract_all("answer", F.lit(CITATION), 1), F.lower)
    return answers.select(*key, F.posexplode(refs).alias("_p", "ref")).select(*key, "ref", (F.col("_p") + 1).cast("long").alias("pos"))


def _answers(spark, d):
    n = lambda c: F.format_string("%d", c)
    mark = F.concat(F.lit(" [sec."), n(F.col("turn") + 1), F.lit("."), n(F.col("conv_id") % 5), F.lit("-ssec.2]"))
    text = F.concat("text", mark, F.lit(" and [DCP.10."), n(F.col("conv_id") % 3), F.lit("]"), mark, F.lit(" [zone.x]"))
    return table(spark, d, "conversations").select("conv_id", "turn", text.alias("answer"))


@query(f"WITH {_CITED} SELECT * FROM m")
def cite_extract(spark, d):
    return cited(_answers(spark, d), ["conv_id", "turn"])


@query(f"WITH {_CITED}, f AS (SELECT conv_id, turn, ref, min(pos) AS pos FROM m WHERE ref NOT LIKE 'sec.1.%' GROUP BY ALL) SELECT conv_id, turn, ref, row_number() OVER (PARTITION BY conv_id, turn ORDER BY pos)::INT AS number FROM f")
def cite_number(spark, d):
    """Numbers by first appearance; references to sections that were not retrieved (here part 1) are left out."""
    first = cited(_answers(spark, d), ["conv_id", "turn"]).filter(~F.col("ref").startswith("sec.1.")).groupBy("conv_id", "turn", "ref").agg(F.min("pos").alias("pos"))
    return first.select("conv_id", "turn", "ref", F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("pos")).alias("number"))


@query(r"""WITH s AS (SELECT doc_id, trim(text) AS s FROM documents), p AS (SELECT *, CASE WHEN regexp_matches(s, '[.!?](\s|$)') THEN length(regexp_extract(s, '^(?s)(.*?)[.!?](\s|$)', 1)) ELSE -1 END AS stop FROM s)
           SELECT doc_id, CASE WHEN stop > 20 AND stop < 240 THEN left(s, stop + 1) WHEN length(s) > 200 THEN left(s, 200) || '…' ELSE s END AS quote FROM p""")
def cite_quote(spark, d):
    return table(spark, d, "documents").select("doc_id", quote(F.col("text")).alias("quote"))


_SECTION = "CASE p_partkey % 6 WHEN 0 THEN 'sec.4.' || p_size || '-ssec.2' WHEN 1 THEN 'sec.2.' || p_size || '-ssec.3-para1.a' WHEN 2 THEN 'sch.' || p_size || '-sec.15-ssec.1' WHEN 3 THEN 'pt.' || p_size WHEN 4 THEN 'ch.5-pt.' || p_size ELSE 'dcp.10.' || p_size END"


@query(f"""SELECT p_partkey, {_SECTION} AS section, CASE p_partkey % 6 WHEN 0 THEN 'cl 4.' || p_size || '(2)' WHEN 1 THEN 'cl 2.' || p_size || '(3)(a)' WHEN 2 THEN 'Sch ' || p_size || ' cl 15(1)' WHEN 3 THEN 'Part ' || p_size
           WHEN 4 THEN 'Ch 5 Pt ' || p_size ELSE 's 10.' || p_size END AS label FROM part""")
def cite_format(spark, d):
    k, n = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    forms = ["sec.4.%s-ssec.2", "sec.2.%s-ssec.3-para1.a", "sch.%s-sec.15-ssec.1", "pt.%s", "ch.5-pt.%s", "dcp.10.%s"]
    section = F.format_string(forms[5], n)
    for i, f in enumerate(forms[:5]):
        section = F.when(k == i, F.format_string(f, n)).otherwise(section)
    return table(spark, d, "part").select("p_partkey", section.alias("section")).withColumn("label", section_label(F.col("section")))


@query("""SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name || ' LEP' WHEN 1 THEN n_name || ' DCP' WHEN 2 THEN 'Housing SEPP' ELSE n_name || ' SEPP' END AS label FROM nation""")
def doc_label(spark, d):
    k, name = F.col("n_nationkey") % 4, F.col("n_name")
    title = F.when(k == 0, F.concat(name, F.lit(" Local Environmental Plan 2010"))).when(k == 1, F.concat(name, F.lit(" Development Control Plan 2013"))).when(k == 2, F.lit("State Policy (Housing) 2021")).otherwise(F.concat(F.lit("State Policy ("), name, F.lit(") 2020")))
    kind = F.when(k == 0, "lep").when(k == 1, "dcp").otherwise("sepp")
    return table(spark, d, "nation").select("n_nationkey", document_label(title, kind).alias("label"))


@query("""SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand || ' | State-wide' ELSE p_brand || ' | ' || p_type END || ' — [' || p_type || '] ' || p_name || ' has size' || CASE WHEN p_size > 25 THEN ' (max ' || p_size || ' cm)' ELSE '' END AS text FROM part""")
def prop_text(spark, d):
    big = F.col("p_size") > 25
    rows = table(spark, d, "part").select(
        "p_partkey", F.col("p_brand").alias("document_title"), F.when(~big, F.col("p_type")).alias("lga_name"), F.when(big, "state").alias("scope"), F.col("p_type").alias("type"), F.col("p_name").alias("subject"), F.lit("has").alias("predicate"),
        F.lit("size").alias("object"), F.lit("max").alias("comparator"), F.when(big, F.col("p_size")).alias("value"), F.lit("cm").alias("unit"),
    )
    return rows.select("p_partkey", proposition_text(rows).alias("text"))
