"""SQL of the Porter2 rules: a table expression `stems` (word, stem) of the words of all documents."""

from __future__ import annotations

_REGION = "'^[^aeiouy]*[aeiouy]+[^aeiouy]'"
_SHORT = "'(^[aeiouy][^aeiouy]|(^|[^aeiouy])[aeiouy][^aeiouywxY])$'"


def _step(rules: str, at_least: str) -> str:
    """A CASE over endings from long to short, each `ending>replacement` with an optional pattern of what has to stand before it."""
    out = []
    for rule in rules.split():
        end, _, new = rule.partition(">")
        new, _, before = new.partition("|")
        n, ok = len(end), f"length(w) - {len(end)} >= {'r2' if end == 'ative' else at_least}"
        ok += f" AND regexp_matches(w, '{before}{end}$')" if before else ""
        out.append(f"WHEN w LIKE '%{end}' THEN CASE WHEN {ok} THEN left(w, length(w) - {n}) || '{new}' ELSE w END")
    return "CASE " + " ".join(out) + " ELSE w END"


_TWO = _step("ational>ate fulness>ful iveness>ive ization>ize ousness>ous biliti>ble lessli>less tional>tion alism>al aliti>al ation>ate entli>ent fulli>ful iviti>ive ousli>ous abli>able alli>al anci>ance ator>ate enci>ence izer>ize bli>ble ogi>og|l li>|[cdeghkmnrt]", "r1")
_THREE = _step("ational>ate tional>tion alize>al ative> icate>ic iciti>ic ical>ic ness> ful>", "r1")
_FOUR = _step("ement> able> ance> ence> ible> ment> ant> ate> ent> ion>|[st] ism> iti> ive> ize> ous> al> er> ic>", "r2")

STEMS_SQL = f"""words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+')) AS word FROM documents),
    z0 AS (SELECT word, regexp_replace(regexp_replace(word, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS w FROM words),
    z1 AS (SELECT *, coalesce(nullif(length(regexp_extract(w, '^(gener|commun|arsen)')), 0), nullif(length(regexp_extract(w, {_REGION})), 0), length(w)) AS r1 FROM z0),
    z2 AS (SELECT *, r1 + coalesce(nullif(length(regexp_extract(w[r1 + 1:], {_REGION})), 0), length(w) - r1) AS r2 FROM z1),
    z3 AS (SELECT word, r1, r2, CASE WHEN w LIKE '%sses' THEN left(w, length(w) - 2) WHEN regexp_matches(w, '..ie[ds]$') THEN left(w, length(w) - 2) WHEN regexp_matches(w, 'ie[ds]$') THEN left(w, length(w) - 1)
           WHEN regexp_matches(w, '[us]s$') THEN w WHEN regexp_matches(w, '[aeiouy].+s$') THEN left(w, length(w) - 1) ELSE w END AS w FROM z2),
    z4 AS (SELECT *, w AS kept, CASE WHEN regexp_matches(w, '[aeiouy].*(ed|ing)(ly)?$') AND NOT regexp_matches(w, 'eed(ly)?$') THEN regexp_replace(w, '(ed|ing)(ly)?$', '') END AS cut FROM z3),
    z5 AS (SELECT word, kept, r1, r2, CASE WHEN regexp_matches(w, 'eed(ly)?$') THEN CASE WHEN length(regexp_replace(w, 'eed(ly)?$', '')) >= r1 THEN regexp_replace(w, 'eed(ly)?$', 'ee') ELSE w END
           WHEN cut IS NULL THEN w WHEN regexp_matches(cut, '(at|bl|iz)$') THEN cut || 'e' WHEN regexp_matches(cut, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left(cut, length(cut) - 1)
           WHEN length(cut) <= r1 AND regexp_matches(cut, {_SHORT}) THEN cut || 'e' ELSE cut END AS w FROM z4),
    z6 AS (SELECT word, kept, r1, r2, CASE WHEN regexp_matches(w, '.[^aeiouy][yY]$') THEN left(w, length(w) - 1) || 'i' ELSE w END AS w FROM z5),
    z7 AS (SELECT word, kept, r1, r2, {_TWO} AS w FROM z6), z8 AS (SELECT word, kept, r1, r2, {_THREE} AS w FROM z7), z9 AS (SELECT word, kept, r1, r2, {_FOUR} AS w FROM z8),
    za AS (SELECT word, kept, CASE WHEN w LIKE '%e' AND (length(w) > r2 OR (length(w) > r1 AND NOT regexp_matches(left(w, length(w) - 1), {_SHORT}))) THEN left(w, length(w) - 1)
           WHEN w LIKE '%ll' AND length(w) > r2 THEN left(w, length(w) - 1) ELSE w END AS w FROM z9),
    stems AS MATERIALIZED (SELECT word, CASE WHEN length(word) <= 2 THEN word WHEN word IN ('sky', 'news', 'howe', 'atlas', 'cosmos', 'bias', 'andes') THEN word
           WHEN kept IN ('inning', 'outing', 'canning', 'herring', 'earring', 'proceed', 'exceed', 'succeed') THEN kept
           ELSE coalesce(map(['skis', 'skies', 'dying', 'lying', 'tying', 'idly', 'gently', 'ugly', 'early', 'only', 'singly'], ['ski', 'sky', 'die', 'lie', 'tie', 'idl', 'gentl', 'ugli', 'earli', 'onli', 'singl'])[word], lower(w)) END AS stem FROM za)"""
