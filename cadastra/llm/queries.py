"""The operators' queries over the whole of their tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadastra.llm.common import crc_rest, table
from cadastra.llm.exact_dedup import exact_classes
from cadastra.llm.fill_in_middle import fill_in_middle, restored
from cadastra.llm.language_id import fit as fit_languages
from cadastra.llm.language_id import identify
from cadastra.llm.lm_scoring import lm_scores
from cadastra.llm.minhash import near_classes
from cadastra.llm.mixing import mix
from cadastra.llm.quality_classifier import fit as fit_classifier
from cadastra.llm.quality_classifier import score
from cadastra.llm.quality_rules import fit, judge
from cadastra.llm.sentencepiece_codec import encode_documents
from cadastra.llm.sharding import kd_shards
from cadastra.llm.simhash import simhash_classes
from cadastra.llm.spelling import misspelt, variants
from cadastra.llm.warc import warc_pages


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_rest(F.col("doc_id"), 5) == 0
    found = score(docs, fit_classifier(docs, table(spark, sf_dir, "labels"), held_out))
    return found.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents"))


def op4_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(table(spark, sf_dir, "documents"), shards=16)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_scores(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("log_score", 6).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_classes(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = crc_rest(F.col("doc_id"), 3) == 1
    found = identify(docs, fit_languages(docs, held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, fit(docs, table(spark, sf_dir, "labels")))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_pages(table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fill_in_middle(table(spark, sf_dir, "documents"))
    sha = lambda x: F.sha2(F.encode(x, "UTF-8"), 256)
    return found.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(misspelt(table(spark, sf_dir, "documents")))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_classes(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality_classifier, op2_sentencepiece, op3_minhash, op4_kd_shards, op5_lm_scoring, op6_exact_dedup, op7_language_id, op8_mix_sources, op9_quality_rules, op10_warc, op11_fill_in_middle, op12_spelling_variants, op13_simhash)}

#: 32 letters of base32 for the 40 hex digits of SHA-1: five bits at a time.
_BASE32 = "array_to_string(list_transform(range(32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || d[1 + 10 * (k // 8):10 + 10 * (k // 8)])::BIGINT >> (35 - 5 * (k % 8))) & 31)]), '')"

ORACLES: dict[str, str] = {
    "op3_minhash": r"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
             s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
             n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
             p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
             e AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
             b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
             r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, b.v FROM r JOIN b ON b.u = r.c)
        SELECT r.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op5_lm_scoring": r"""
        WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
             p AS (SELECT doc_id, len(ws) AS n_words, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t WHERE len(ws) > 0),
             q AS (SELECT *, lag(w) OVER d AS v, lag(w, 2) OVER d AS u, least(i, 3) AS can FROM p WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
             c AS (SELECT *, count(*) OVER (PARTITION BY w) - count(*) OVER (PARTITION BY doc_id, w) AS c1, count(*) OVER (PARTITION BY v, w) - count(*) OVER (PARTITION BY doc_id, v, w) AS c2,
                          count(*) OVER (PARTITION BY u, v, w) - count(*) OVER (PARTITION BY doc_id, u, v, w) AS c3, count(*) OVER () AS n FROM q),
             d AS (SELECT *, lag(c1) OVER d AS below1, lag(c2) OVER d AS below2 FROM c WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
             s AS (SELECT doc_id, ln(CASE WHEN i > 2 AND c3 > 0 THEN c3 / below2 WHEN i > 1 AND c2 > 0 THEN pow(0.4::DOUBLE, can - 2) * c2 / below1
                                          WHEN c1 > 0 THEN pow(0.4::DOUBLE, can - 1) * c1 / (n - n_words) ELSE pow(0.4::DOUBLE, can) / n END) AS s FROM d),
             g AS (SELECT doc_id, sum(s) AS s FROM s GROUP BY doc_id)
        SELECT t.doc_id, len(ws)::BIGINT AS n_words, round(coalesce(g.s, 0), 6) AS log_score, round(g.s / nullif(len(ws), 0), 6) AS mean_log_score
        FROM t LEFT JOIN g USING (doc_id)""",
    "op6_exact_dedup": r"""
        WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
        SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = first_value(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id)""",
    "op10_warc": f"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
             d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS d FROM p),
             t AS (SELECT *, max(page_id) OVER (PARTITION BY d) AS top FROM d)
        SELECT page_id, payload_bytes, {_BASE32} AS payload_digest, CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id < top THEN top END AS refers_to FROM t""",
    "op11_fill_in_middle": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id::VARCHAR) AS s FROM documents),
             h AS (SELECT doc_id, text, u, len(u) AS n, [('0x' || s[8 * k + 1:8 * k + 8])::BIGINT FOR k IN range(4)] AS h FROM t),
             c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
                          CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
             p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM c)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(text) AS restored_sha256
        FROM p""",
    "op12_spelling_variants": r"""
        WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run FROM documents),
             d AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= 5 GROUP BY ALL),
             -- crc32: each byte of the UTF-8 form, then seven zeros, for eight shifts a byte
             b AS (SELECT run, n, flatten(list_transform(string_split(doc_id::VARCHAR || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c), 0, 0, 0, 0, 0, 0, 0] ELSE [195, 0, 0, 0, 0, 0, 0, 0, unicode(c) - 64, 0, 0, 0, 0, 0, 0, 0] END)) AS steps FROM d),
             h AS (SELECT run, n, xor(list_reduce(list_transform(steps, lambda x: x::BIGINT), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)), 4294967295::BIGINT), 4294967295::BIGINT) AS h FROM b),
             w AS (SELECT CASE WHEN h % 97 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, sum(n)::BIGINT AS n FROM h GROUP BY ALL),
             f AS MATERIALIZED (SELECT word, n FROM w WHERE length(word) >= 5 AND n >= 3),
             -- words without one letter: two of them with the same rest differ by a replacement, one with a whole word by an insertion
             o AS MATERIALIZED (SELECT word, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM f)),
             e AS MATERIALIZED (SELECT a.word AS u, b.word AS v FROM o a JOIN o b ON a.i = b.i AND a.rest = b.rest AND a.word < b.word UNION SELECT o.word, f.word FROM o JOIN f ON o.rest = f.word),
             p AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
             g AS (SELECT u AS word, count(*) AS n_near, first(v ORDER BY n DESC, v) AS v, max(n) AS m FROM p JOIN f ON f.word = p.v GROUP BY u),
             s AS MATERIALIZED (SELECT f.word, f.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * f.n THEN g.v END AS form, CASE WHEN m >= 2 * f.n THEN m END AS form_n FROM f LEFT JOIN g USING (word)),
             k AS (SELECT word, word AS root FROM s UNION ALL SELECT k.word, s.form FROM k JOIN s ON s.word = k.root WHERE s.form IS NOT NULL)
        SELECT s.word, s.form, k.root, s.n, s.n_near, s.form_n FROM s JOIN k ON k.word = s.word JOIN s l ON l.word = k.root AND l.form IS NULL""",
}
