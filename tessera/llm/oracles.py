"""SQL for the training-data queries that SQL can express: op1 to op3 by plain joins over all pairs, op8 by
windows, op11 by all pairs of a query and a row."""

from __future__ import annotations

from .quality import LEAST_REPEAT, LONGEST_FLOOR, MOST_COVERED, MOST_LONGEST
from .secrets import ACCESS, ASSIGN, ENDPOINT, HEX, IDENT, KEY, KINDS, MAY_BE_ID, OPAQUE, REACH, TURNS

def _reached(name: str) -> str:
    """Rows are nodes, as each is judged by itself; of those that a row reaches, the smallest id names its component."""
    return f"""
reached AS (SELECT node, node AS to_ FROM nodes UNION SELECT reached.node, links.b FROM reached JOIN links ON links.a = reached.to_),
comp AS (SELECT node, min({name}) AS component_id FROM reached JOIN numbered ON r = to_ GROUP BY node)"""


def _op1() -> str:
    return f"""WITH RECURSIVE numbered AS (SELECT row_number() OVER () AS r, vec_id, label, embedding FROM embeddings),
usable AS (
  SELECT r, label, embedding::DOUBLE[] AS e FROM numbered
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.r AS a, b.r AS b FROM usable a JOIN usable b ON a.label = b.label AND a.r <> b.r AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
nodes AS (SELECT DISTINCT a AS node FROM links), {_reached("vec_id")},
counted AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(component_id, vec_id) AS component_id, coalesce(coalesce(component_id, vec_id) = vec_id, true) AS kept
FROM numbered LEFT JOIN comp ON node = r LEFT JOIN counted ON a = r"""


def _op3() -> str:
    low = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""WITH RECURSIVE numbered AS (SELECT row_number() OVER () AS r, doc_id, text FROM documents),
words AS (SELECT r, doc_id, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') AS w FROM numbered),
shingles AS (SELECT DISTINCT r, doc_id, array_to_string(w[k:k+4], ' ') AS s FROM (SELECT r, doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM shingles GROUP BY r),
shared AS (SELECT x.r AS a, y.r AS b, count(*) AS both_ FROM shingles x JOIN shingles y ON x.s = y.s AND x.r <> y.r WHERE x.doc_id IS NOT NULL AND y.doc_id IS NOT NULL GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.r = a JOIN sizes q ON q.r = b WHERE 100 * both_ >= 75 * (p.n + q.n - both_)),
nodes AS (SELECT DISTINCT a AS node FROM links), {_reached("doc_id")}
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, d.doc_id) AS component_id, coalesce(coalesce(component_id, d.doc_id) = d.doc_id, true) AS kept
FROM numbered d LEFT JOIN sizes USING (r) LEFT JOIN comp ON node = d.r"""


def _found(kind: int, pattern: str, group: int = 0) -> str:
    p = "'" + pattern.replace("'", "''") + "'"
    return f"""SELECT doc_id, {kind} AS k, v, whole[i] AS whole, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + list_sum(list_transform(whole[1:i], lambda x: length(x)))::BIGINT - length(whole[i]) AS s,
    list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + list_sum(list_transform(whole[1:i], lambda x: length(x)))::BIGINT AS e
  FROM (SELECT *, length(value_[i]) AS v FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
    SELECT doc_id, string_split_regex(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS whole, regexp_extract_all(text, {p}, {group}) AS value_ FROM texts)))"""


def _op2() -> str:
    names = "[" + ", ".join(f"'{k}'" for k in KINDS) + "]"
    label = f"{names}[k + 1] || ':' || s || ':' || e"
    return f"""WITH texts AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
assigned AS ({_found(0, ASSIGN, 2)}),
base AS (SELECT doc_id, k, s, e FROM assigned WHERE v >= 12 UNION ALL SELECT doc_id, k, s, e FROM ({_found(1, ACCESS)}) UNION ALL SELECT doc_id, k, s, e FROM ({_found(2, HEX)})),
keyed AS (SELECT doc_id, CASE WHEN regexp_matches(whole, '{MAY_BE_ID}') THEN 6 ELSE 5 END AS k, s, e FROM ({_found(5, KEY)})),
unnamed AS (SELECT doc_id, k, s, e FROM ({_found(5, OPAQUE)}) WHERE regexp_matches(whole, '[0-9+/]') AND regexp_matches(whole, '[A-Z]') AND regexp_matches(whole, '[a-z]')
  AND len(regexp_extract_all(regexp_replace(whole, '[+/=]', '', 'g'), '{TURNS}')) * 10 >= length(whole) * 3),
candidates AS (SELECT doc_id, 1 AS t, k, s, e FROM ({_found(3, IDENT)}) UNION ALL SELECT doc_id, 1, k, s, e FROM ({_found(4, ENDPOINT)}) UNION ALL SELECT doc_id, 1, 5, s, e FROM assigned WHERE v BETWEEN 6 AND 11
  UNION ALL SELECT doc_id, 2, k, s, e FROM keyed UNION ALL SELECT doc_id, 3, k, s, e FROM unnamed),
soft AS (SELECT doc_id, k, s, e FROM candidates c WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, 0 AS t, s, e FROM base UNION ALL SELECT doc_id, t, s, e FROM candidates) b WHERE b.doc_id = c.doc_id AND b.t < c.t AND b.s < c.e AND c.s < b.e)),
parts AS (SELECT doc_id, k, s, CASE WHEN k IN (1, 3) THEN 1 WHEN k = 4 THEN 4 WHEN k = 6 THEN 3 ELSE 2 END AS role FROM (SELECT doc_id, k, s FROM base UNION ALL SELECT doc_id, k, s FROM soft)),
met AS (SELECT w.doc_id, w.k, w.s, w.e, bit_or(p.role) AS met FROM soft w JOIN parts p ON p.doc_id = w.doc_id AND abs(p.s - w.s) <= {REACH} AND (p.s <> w.s OR p.k <> w.k) GROUP BY ALL),
linked AS (SELECT doc_id, least(k, 5) AS k, s, e FROM met WHERE (k = 3 AND met & 2 > 0) OR (k = 4 AND met & 3 = 3) OR (k = 5 AND met & 5 > 0) OR k = 6),
firm AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, string_agg({label}, ',' ORDER BY s, k) AS spans FROM base GROUP BY doc_id),
every AS (SELECT doc_id, string_agg({label}, ',' ORDER BY s, k) AS spans FROM (SELECT * FROM base UNION ALL SELECT * FROM linked) GROUP BY doc_id),
extra AS (SELECT doc_id, count(*) AS n FROM linked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(firm.spans, '')) AS base_sha256, coalesce(every.spans, '') AS spans, coalesce(extra.n, 0) AS n_linked
FROM documents d LEFT JOIN firm USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN extra USING (doc_id)"""


def _op8() -> str:
    """Repeats of at least n words cover what n-word windows that occur twice cover; a repeat of more than m words is a
    window of m + 1 words that occurs twice."""
    space = "[\\x20\\x09-\\x0D]"
    phrase = lambda size: "word || ' ' || " + " || ' ' || ".join(f"lead(word, {k}) OVER w" for k in range(1, size))
    again = lambda size: f"(SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, p) AS c FROM (SELECT doc_id, k, {phrase(size)} AS p FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY k)) WHERE p IS NOT NULL) WHERE c > 1)"
    return f"""WITH words AS (
  SELECT *, greatest({LONGEST_FLOOR}, floor({MOST_LONGEST} * n)::BIGINT) + 1 AS m FROM (
    SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n FROM documents)),
tokens AS (SELECT doc_id, generate_subscripts(w, 1) AS k, unnest(w) AS word FROM words),
short AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest(range(k, k + 5)) AS p FROM {again(5)}) GROUP BY doc_id),
long AS (SELECT doc_id, count(DISTINCT p) AS c FROM (SELECT doc_id, unnest(range(k, k + {LEAST_REPEAT})) AS p FROM {again(LEAST_REPEAT)}) GROUP BY doc_id),
-- texts with so much covered that a single repeat may be too long, and too little to fail for that alone
unsure AS (SELECT words.* FROM words JOIN long USING (doc_id) WHERE c >= m AND c <= {MOST_COVERED} * n),
huge AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY doc_id, hash(w[k:k+m-1])) AS c FROM (SELECT doc_id, w, m, unnest(range(1, n - m + 2)) AS k FROM unsure)) WHERE c > 1),
lines AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) AS l FROM words),
figures AS (SELECT d.doc_id, n AS n_words, length(regexp_replace(text, '{space}', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, coalesce(c, 0) AS covered_words, huge.doc_id IS NOT NULL AS huge
  FROM words d JOIN lines USING (doc_id) LEFT JOIN short USING (doc_id) LEFT JOIN long USING (doc_id) LEFT JOIN huge USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR covered_words > {MOST_COVERED} * n_words OR huge) AS kept, covered_words FROM figures"""


def _op11() -> str:
    """Every query against every row, as sums of whole numbers in doubles, exact up to 2**53."""
    return """WITH scaled AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT query_id, rank, vec_id, score FROM (
  SELECT q.vec_id AS query_id, q.r, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
    row_number() OVER (PARTITION BY q.r ORDER BY list_inner_product(q.v, c.v)::BIGINT DESC, c.vec_id)::INTEGER AS rank
  FROM scaled q JOIN scaled c ON q.vec_id % 100 = 0 AND q.r <> c.r AND len(q.v) = len(c.v))
WHERE rank <= 10"""


def oracle_sql() -> dict[str, str]:
    return {"op1_embedding_near_dedup": _op1(), "op2_secret_scan": _op2(), "op3_minhash_near_dedup": _op3(), "op8_quality_rules": _op8(), "op11_exact_topk": _op11()}
