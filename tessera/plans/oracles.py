"""SQL that checks the registered queries, for DuckDB over the same tables. Written apart from the DataFrame programs."""

from __future__ import annotations

from ..functions import constants as C
from .registry import SALT, SCAN_THRESHOLDS, SCAN_TYPES

# White space that Python's strip takes off, as far as a byte of Latin-1.
_WS = "' ' || " + " || ".join(f"chr({c})" for c in (9, 10, 11, 12, 13, 28, 29, 30, 31, 133, 160))
_SEP = "chr(31)"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words) -> str:
    return "[" + ", ".join(_q(w) for w in words) + "]"


def _strip(x: str) -> str:
    return f"trim({x}, {_WS})"


def _tok(x: str) -> str:
    return f"regexp_extract_all(lower({x}), '[a-z0-9]+')"


def _set(x: str, stop=()) -> str:
    s = f"list_distinct({_tok(x)})"
    return f"list_filter({s}, lambda w: NOT list_contains({_list(stop)}, w))" if stop else s


def _sents(x: str, lines: bool = False) -> str:
    """Ends of sentences are marked by a control character first, as there is no look-behind."""
    marked = rf"regexp_replace({_strip(x)}, '([.!?])\s+', '\1' || chr(1), 'g')"
    if lines:
        marked = rf"regexp_replace({marked}, '\n+', chr(1), 'g')"
    return f"list_filter(list_transform(string_split({marked}, chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"


def _json(x: str) -> str:
    """A JSON string of ASCII alone."""
    n = "unicode(c)"
    pair = f"printf('\\u%04x\\u%04x', 55296 + (({n} - 65536) >> 10), 56320 + (({n} - 65536) & 1023))"
    short = " ".join(f"WHEN {n} = {code} THEN '\\{letter}'" for code, letter in ((10, "n"), (13, "r"), (9, "t"), (12, "f"), (8, "b")))
    one = f"CASE WHEN c = chr(34) OR c = chr(92) THEN chr(92) || c {short} WHEN {n} BETWEEN 32 AND 126 THEN c WHEN {n} > 65535 THEN {pair} ELSE printf('\\u%04x', {n}) END"
    return f"'\"' || array_to_string(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: {one}), '') || '\"'"


def _words(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def _ground(claim: str, context_set: str) -> str:
    own = _set(claim, C.GROUND_STOP)
    return f"(CASE WHEN len({own}) = 0 THEN 1.0 ELSE len(list_intersect({own}, {context_set}))::DOUBLE / len({own}) END)"


def _mean(scores: str) -> str:
    return f"(CASE WHEN len({scores}) = 0 THEN 1.0 ELSE list_sum({scores})::DOUBLE / len({scores}) END)"


def fixed_chunks(docs: str = "documents") -> str:
    """Chunks of the texts of a table (doc_id, text), in `ordered`."""
    return f"""
windows AS (
  SELECT doc_id, text, s, length(text) AS n
  FROM (SELECT doc_id, text, unnest(range(0, length(text), 680)) AS s FROM {docs} WHERE length(text) > 0)
  WHERE s = 0 OR s - 680 + 800 < length(text)
), chunks AS (
  SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s) - 1)::INTEGER AS idx, piece AS text, s::INTEGER AS start, least(s + 800, n)::INTEGER AS stop
  FROM (SELECT *, {_strip('substr(text, s + 1, 800)')} AS piece FROM windows) WHERE piece <> ''
), ordered AS (SELECT *, doc_id * 1048576 + idx AS chunk_ord, doc_id || '#c' || idx AS chunk_id FROM chunks)"""


_CHUNKS = fixed_chunks()

_INDEX = f"""
occurrences AS (SELECT chunk_ord, unnest({_tok('text')}) AS term FROM ordered),
lengths AS (SELECT chunk_ord, len({_tok('text')}) AS dl FROM ordered),
stats AS (SELECT count(*) AS n, sum(dl)::DOUBLE / greatest(count(*), 1) AS avgdl FROM lengths),
postings AS (SELECT term, chunk_ord, count(*) AS tf FROM occurrences GROUP BY ALL),
dictionary AS (SELECT term, df, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM (SELECT term, count(*) AS df FROM postings GROUP BY term), stats)"""


def _bm25(n: int) -> str:
    return f"""
q_terms AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({_tok('text')}) AS term FROM benchmark) GROUP BY ALL),
bm25_hits AS (
  SELECT qid, chunk_ord, round(sum(qtf * idf * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * greatest(dl, 1) / avgdl)))), 9) AS score
  FROM q_terms JOIN dictionary USING (term) JOIN postings USING (term) JOIN lengths USING (chunk_ord), stats GROUP BY ALL),
bm25_all AS (
  SELECT item_id AS qid, o.chunk_ord, coalesce(score, 0.0) AS score
  FROM benchmark CROSS JOIN ordered o LEFT JOIN bm25_hits h ON h.qid = item_id AND h.chunk_ord = o.chunk_ord),
bm25 AS (SELECT qid, chunk_ord, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_ord) AS rank FROM bm25_all QUALIFY rank <= {n})"""


def _hash_bucket(groups: int) -> str:
    parts = [f"CAST('0x' || substr(h, {4 * k + 1}, 4) AS INTEGER) * {pow(65536, groups - 1 - k, 384)}" for k in range(groups)]
    return "((" + " + ".join(parts) + ") % 384)::INTEGER"


def _vectors(name: str, key: str, source: str) -> str:
    """Unit vectors as (key, bucket, w)."""
    return f"""
{name}_t AS (SELECT {key}, sha256(term) AS h, count(*) AS tf FROM (SELECT {key}, unnest({_tok('text')}) AS term FROM {source}) GROUP BY ALL),
{name}_r AS (SELECT {key}, bucket, sum(x) AS x FROM (
  SELECT {key}, {_hash_bucket(16)} AS bucket, tf * 1.0 AS x FROM {name}_t UNION ALL SELECT {key}, {_hash_bucket(15)}, tf * 0.5 FROM {name}_t) GROUP BY ALL),
{name} AS (SELECT {key}, bucket, (x / sqrt(sum(x * x) OVER (PARTITION BY {key})))::DOUBLE AS w FROM {name}_r)"""


_DENSE = (
    _vectors("cv", "chunk_ord", "ordered")
    + ","
    + _vectors("qv", "item_id", "benchmark")
    + """,
dense_hits AS (SELECT item_id AS qid, chunk_ord, round(sum(qv.w * cv.w), 9) AS score FROM qv JOIN cv USING (bucket) GROUP BY ALL),
dense_all AS (SELECT item_id AS qid, o.chunk_ord, coalesce(score, 0.0) AS score FROM benchmark CROSS JOIN ordered o LEFT JOIN dense_hits h ON h.qid = item_id AND h.chunk_ord = o.chunk_ord),
dense AS (SELECT qid, chunk_ord, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, chunk_ord) AS rank FROM dense_all QUALIFY rank <= 20)"""
)

_FUSED = """
fused AS (
  SELECT qid, chunk_ord, coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) AS fused,
    row_number() OVER (PARTITION BY qid ORDER BY coalesce(1.0::DOUBLE / (60 + d.rank), 0) + coalesce(1.0::DOUBLE / (60 + b.rank), 0) DESC, d.rank NULLS LAST, b.rank NULLS LAST) AS fused_rank
  FROM dense d FULL JOIN bm25 b USING (qid, chunk_ord) QUALIFY fused_rank <= 20)"""


def _reranked(candidates: str) -> str:
    own = _set("b.text", C.RERANK_STOP)
    return f"""
reranked AS (
  SELECT c.qid, c.chunk_ord, o.chunk_id, o.doc_id, o.text, len(list_intersect({own}, {_set('o.text')}))::DOUBLE / greatest(len({own}), 1) AS score,
    row_number() OVER (PARTITION BY c.qid ORDER BY len(list_intersect({own}, {_set('o.text')}))::DOUBLE / greatest(len({own}), 1) DESC, c.fused_rank) AS rank
  FROM {candidates} c JOIN ordered o USING (chunk_ord) JOIN benchmark b ON b.item_id = c.qid QUALIFY rank <= 5)"""


_TURNS = """turns AS (
  SELECT conv_id, turn, text AS question, answer FROM (
    SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS answer FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
  WHERE role = 'user' AND next_role = 'assistant')"""


_SECTIONS = f"""lines AS (SELECT doc_id, generate_subscripts(l, 1) AS k, unnest(l) AS line FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e]') AS l FROM documents)),
marked AS (SELECT *, sum(CASE WHEN k > 1 AND regexp_matches({_strip('line')}, {_q(C.HEADER)}) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS part FROM lines),
whole AS (SELECT doc_id, part, {_strip("string_agg(line, chr(10) ORDER BY k)")} AS section FROM marked GROUP BY doc_id, part)"""


def _merged(most: int, least: int) -> str:
    """Chunks of merged sections (doc_id, i, text, start, stop): a walk over each document's units, which are short sections
    (2), the beginnings of long ones (0), and their sentences (1); then a walk over the chunks that finds their places."""
    fits = f"length(w.buf) + length(u.t) <= {most}"
    flush = f"CASE u.k WHEN 0 THEN w.buf <> '' WHEN 1 THEN NOT ({fits}) AND length(w.buf) >= {least} ELSE NOT ({fits}) END"
    return f"""{_SECTIONS},
listed AS (SELECT doc_id, part, CASE WHEN length(section) > {most} THEN list_concat([{{'k': 0, 't': ''}}], list_transform({_sents('section', True)}, lambda x: {{'k': 1, 't': x}})) ELSE [{{'k': 2, 't': section}}] END AS us FROM whole WHERE section <> ''),
units AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, j) AS n, u.k AS k, u.t AS t FROM (SELECT doc_id, part, generate_subscripts(us, 1) AS j, unnest(us) AS u FROM listed)),
buffers AS (
  SELECT doc_id, 0::BIGINT AS n, '' AS buf, NULL::VARCHAR AS done FROM (SELECT DISTINCT doc_id FROM units)
  UNION ALL
  SELECT u.doc_id, u.n, CASE WHEN u.k = 0 THEN '' WHEN {flush} THEN {_strip('u.t')} ELSE {_strip("w.buf || CASE u.k WHEN 1 THEN ' ' ELSE chr(10) END || u.t")} END, CASE WHEN {flush} THEN w.buf END
  FROM buffers w JOIN units u ON u.doc_id = w.doc_id AND u.n = w.n + 1),
merged AS (
  SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS i, c AS text FROM (
    SELECT doc_id, n, done AS c FROM buffers WHERE done IS NOT NULL
    UNION ALL SELECT doc_id, n + 1, buf FROM buffers QUALIFY n = max(n) OVER (PARTITION BY doc_id) AND {_strip('buf')} <> '')),
located AS (
  SELECT doc_id, -1::BIGINT AS i, 0::BIGINT AS start, 0::BIGINT AS stop, '' AS text FROM (SELECT DISTINCT doc_id FROM merged)
  UNION ALL
  SELECT m.doc_id, m.i, l.stop + greatest(strpos(substr(d.text, l.stop + 1), left(m.text, 40)) - 1, 0), l.stop + greatest(strpos(substr(d.text, l.stop + 1), left(m.text, 40)) - 1, 0) + length(m.text), m.text
  FROM located l JOIN merged m ON m.doc_id = l.doc_id AND m.i = l.i + 1 JOIN documents d ON d.doc_id = m.doc_id)"""


_TREE = f"""{_merged(1500, 200)},
parents AS (SELECT doc_id, i, text, start, stop FROM located WHERE i >= 0),
cuts AS (SELECT doc_id, i, text AS ptext, s, least(s + 400, length(text)) AS e, {_strip('substr(text, s + 1, 400)')} AS text FROM (SELECT *, unnest(range(0, length(text), 340)) AS s FROM parents) WHERE s = 0 OR s + 60 < length(text)),
kids AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, s) - 1 AS idx FROM cuts WHERE text <> ''),
tree AS (
  SELECT doc_id, i, -1 AS s, doc_id || '#c' || i AS chunk_id, text, start, stop, 'semantic' AS strategy, 'parent' AS level, NULL::VARCHAR AS parent_id, NULL::VARCHAR AS parent_text, doc_id::VARCHAR AS owner_id FROM parents
  UNION ALL SELECT doc_id, i, s, doc_id || '#hc' || idx, text, s, e, 'hierarchical', 'child', doc_id || '#c' || i, left(ptext, 500), doc_id || '#c' || i || ':ch' FROM kids)"""


def _two_capitals(entity: str, conf: float, order: int, detector: str) -> str:
    """Pairs of capitalised words behind a small letter and a blank, without look-behind: of a row of words each of which
    could begin a pair, every other one does."""
    word = "'[A-Z][a-z]{2,}'"
    return f"""SELECT doc_id, {_q(entity)} AS entity_type, start, stop, span, {conf}::DOUBLE AS confidence, {order} AS ord, {_q(detector)} AS detector FROM (
  SELECT doc_id, i, start, stop, substr(text, start + 1, stop - start) AS span, row_number() OVER (PARTITION BY doc_id, i - nth ORDER BY i) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS nth FROM (
      SELECT doc_id, text, i, s AS start, lead(e) OVER w AS stop, regexp_matches(substr(text, s - 1, 2), '^[a-z]\\s$') AND s >= 2 AND regexp_matches(substr(text, e + 1, lead(s) OVER w - e), '^\\s+$')
        AND NOT regexp_matches(substr(text, lead(e) OVER w + 1, 1), '\\w') AS begins FROM (
        SELECT doc_id, text, i, ends[i] - length(whole[i]) AS s, ends[i] AS e FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
          SELECT *, list_transform(range(1, len(whole) + 1), lambda j: list_sum(list_transform(gaps[1:j], lambda x: length(x)))::BIGINT + list_sum(list_transform(whole[1:j], lambda x: length(x)))::BIGINT) AS ends FROM (
            SELECT doc_id, text, string_split_regex(text, {word}) AS gaps, regexp_extract_all(text, {word}) AS whole FROM plain)))) WINDOW w AS (PARTITION BY doc_id ORDER BY i))
    WHERE begins)) WHERE place % 2 = 1 AND NOT list_has_any(string_split_regex(span, '\\s+'), {_list(C.NOT_NAMES)})"""


def _pii(types=SCAN_TYPES, thresholds=SCAN_THRESHOLDS) -> str:
    """Spans of all patterns, then overlaps resolved by a walk over each document's spans in order.

    Letters outside ASCII become underscores first, which keeps offsets and makes them word characters to both engines.
    """
    limit = lambda kind: thresholds.get(kind, C.PII_THRESHOLD)
    parts = [(kind, p, conf, k, 0, "regex") for k, (kind, p, conf) in enumerate(C.PII_PATTERNS) if kind in types and conf >= limit(kind)]
    parts += [("PERSON", p, conf, len(C.PII_PATTERNS) + k, 1, "heuristic-ner") for k, (p, conf) in enumerate(C.NAME_PATTERNS) if conf >= limit("PERSON")]
    found = []
    for kind, p, conf, order, group, detector in parts:
        if p.startswith("(?<="):
            found.append(_two_capitals(kind, conf, order, detector))
            continue
        names = f" WHERE NOT list_has_any(string_split_regex(span, '\\s+'), {_list(C.NOT_NAMES)})" if group else ""
        found.append(
            f"""SELECT * FROM (SELECT doc_id, {_q(kind)} AS entity_type, start, start + length(span) AS stop, span, {conf}::DOUBLE AS confidence, {order} AS ord, {_q(detector)} AS detector FROM (
  SELECT doc_id, i, inner_[i] AS span, list_sum(list_transform(gaps[1:i], lambda x: length(x)))::BIGINT + list_sum(list_transform(whole[1:i], lambda x: length(x)))::BIGINT - length(inner_[i]) AS start
  FROM (SELECT *, unnest(range(1, len(whole) + 1)) AS i FROM (
    SELECT doc_id, string_split_regex(text, {_q(p)}) AS gaps, regexp_extract_all(text, {_q(p)}) AS whole, regexp_extract_all(text, {_q(p)}, {group}) AS inner_ FROM plain))))
{names}"""
        )
    return f"""
plain AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[^\\x00-\\x7F]', '_', 'g') AS text FROM documents),
every AS ({' UNION ALL '.join(found)}),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, stop - start DESC, confidence DESC, ord) AS k FROM every),
walk AS (
  SELECT doc_id, k, 1 AS grp, k AS cur, stop, confidence FROM numbered WHERE k = 1
  UNION ALL
  SELECT n.doc_id, n.k, CASE WHEN n.start >= w.stop THEN w.grp + 1 ELSE w.grp END,
    CASE WHEN n.start >= w.stop OR n.confidence > w.confidence THEN n.k ELSE w.cur END,
    CASE WHEN n.start >= w.stop OR n.confidence > w.confidence THEN n.stop ELSE w.stop END,
    CASE WHEN n.start >= w.stop OR n.confidence > w.confidence THEN n.confidence ELSE w.confidence END
  FROM walk w JOIN numbered n ON n.doc_id = w.doc_id AND n.k = w.k + 1),
kept AS (SELECT doc_id, arg_max(cur, k) AS k FROM walk GROUP BY doc_id, grp),
spans AS (
  SELECT doc_id, n.entity_type, n.start, n.stop, substr(d.text, n.start + 1, n.stop - n.start) AS span, n.confidence, n.detector,
    row_number() OVER (PARTITION BY doc_id ORDER BY n.start) AS pos
  FROM kept JOIN numbered n USING (doc_id, k) JOIN documents d USING (doc_id))"""


_PLACED = """
counted AS (SELECT *, row_number() OVER (PARTITION BY doc_id, entity_type ORDER BY start DESC) AS nth FROM spans),
placed AS (
  SELECT *, first_value('[' || entity_type || '_' || nth || ']') OVER (PARTITION BY doc_id, span ORDER BY start DESC) AS placeholder,
    lag(stop, 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS prev_stop FROM counted),
entries AS (SELECT doc_id, placeholder, any_value(span) AS original, max(start) AS made FROM placed GROUP BY doc_id, placeholder),
redacted AS (
  SELECT d.doc_id, CASE WHEN p.doc_id IS NULL THEN coalesce(d.text, '') ELSE p.head || substr(d.text, p.last_stop + 1) END AS redacted
  FROM documents d LEFT JOIN (
    SELECT doc_id, string_agg(substr(t.text, prev_stop + 1, start - prev_stop) || placeholder, '' ORDER BY start) AS head, max(stop) AS last_stop
    FROM placed JOIN documents t USING (doc_id) GROUP BY doc_id) p USING (doc_id))"""


def redacted_documents() -> str:
    """Documents without personal data, in `redacted`; their spans and the entries of their maps beside."""
    return f"WITH RECURSIVE {_pii()}, {_PLACED}"


def _input_guardrail() -> str:
    low = "lower(coalesce(text, ''))"
    cases = [(f"length({_strip('coalesce(text, chr(32))')}) < 3", "Query too short.", "min-length", "'='"), ("length(text) > 2000", "Query exceeds 2000 characters.", "max-length", "'length=' || length(text)")]
    cases += [(f"regexp_matches({low}, {_q(p)})", f"Blocked: suspected {rule}.", rule, _q("pattern=" + p)) for p, rule in C.REQUEST_RULES]
    cases.append((f"NOT list_has_any(regexp_extract_all({low}, '[a-z]+'), {_list(C.TOPIC_WORDS)})", "Query does not appear clinical; strict topic mode is on.", "off-topic", "'='"))
    pick = lambda k, other: "CASE " + " ".join(f"WHEN {c[0]} THEN {c[k] if k == 3 else _q(c[k])}" for c in cases) + f" ELSE {other} END"
    return f"SELECT conv_id, turn, rule IS NULL AS allowed, reason, rule AS triggered_rule, metadata FROM (SELECT conv_id, turn, {pick(1, _q('OK'))} AS reason, {pick(2, 'NULL')} AS rule, {pick(3, _q('='))} AS metadata FROM conversations)"


def _intent(x: str) -> str:
    has = lambda *ws: " OR ".join(f"contains(lower({x}), {_q(w)})" for w in ws)
    return f"CASE WHEN {has('summariz', 'summary', 'tldr', 'overview')} THEN 'summarize' WHEN {has('extract', 'list all', 'what medications', 'allergies')} THEN 'extract' ELSE 'qa' END"


def _disclaimed(x: str) -> str:
    return f"CASE WHEN {x} = '' OR contains(lower({x}), 'disclaimer') THEN {x} ELSE rtrim({x}, {_WS}) || {_q(C.DISCLAIMER)} END"


def _checked(answer: str, context: str) -> str:
    """(conv_id, turn, ground, issues, answer) over turns."""
    return f"""
claims AS (SELECT conv_id, turn, {answer} AS a, {_set(context, C.GROUND_STOP)} AS known, list_filter({_sents(answer)}, lambda s: len({_set('s', C.GROUND_STOP)}) > 3) AS cs FROM turns),
grounded AS (SELECT conv_id, turn, a, list_transform(cs, lambda s: {_ground('s', 'known')}) AS gs FROM claims),
scored AS (SELECT conv_id, turn, a, {_mean('gs')} AS g FROM grounded),
checked AS (SELECT conv_id, turn, a, round_even(g, 3) AS groundedness, list_filter([
    CASE WHEN g < 0.35 THEN 'Low groundedness ' || printf('%.2f', g) || ' < 0.35' END,
    CASE WHEN NOT contains(a, '[doc]') AND NOT contains(a, '[no-') THEN 'Missing source citations' END], lambda x: x IS NOT NULL) AS issues FROM scored)"""


_VERDICT = f"SELECT conv_id, turn, len(issues) = 0 AS allowed, CASE WHEN len(issues) = 0 THEN 'OK' ELSE array_to_string(issues, '; ') END AS reason, groundedness, CASE WHEN len(issues) = 0 THEN {_disclaimed('a')} ELSE a END AS final_text FROM checked"


def _cited(xs: str, sep: str) -> str:
    return f"array_to_string(list_transform({xs}, lambda s: s || ' [doc]'), {sep})"


def _extractive(question: str, context: str) -> str:
    """Sentences by overlap, ties in order: the list is sorted on a key of both."""
    own = _set(question, C.ANSWER_STOP)
    scored = f"list_transform({_sents(context)}, lambda s, i: {{'n': -len(list_intersect({own}, {_set('s')})), 'i': i, 's': s}})"
    best = f"list_filter(list_sort({scored})[1:2], lambda x: x.n < 0)"
    return f"CASE WHEN len({best}) > 0 THEN {_cited(f'list_transform({best}, lambda x: x.s)', chr(39) + ' ' + chr(39))} ELSE {_q(C.NO_EVIDENCE)} END"


def _summary(x: str) -> str:
    return f"CASE WHEN len({_sents(x)}) > 0 THEN {_cited(f'({_sents(x)})[1:3]', chr(39) + ' ' + chr(39))} ELSE {_q(C.NO_SUMMARY)} END"


def _fields(x: str) -> str:
    pattern = r"^\s*([A-Za-z][A-Za-z0-9 _/-]{1,30}):\s*(.+)"
    lines = f"list_filter(string_split_regex({x}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e]'), lambda l: regexp_matches(l, {_q(pattern)}))[1:10]"
    made = f"list_transform({lines}, lambda l: {_strip(f'regexp_extract(l, {_q(pattern)}, 1)')} || ': ' || {_strip(f'regexp_extract(l, {_q(pattern)}, 2)')} || ' [doc]')"
    return f"CASE WHEN len({lines}) > 0 THEN array_to_string({made}, chr(10)) ELSE {_q(C.NO_FIELDS)} END"


_EVENTS = "requests AS (SELECT event_id, user_id, event_type, value, epoch_us(ts) / 1e6 AS at_s FROM events)"
_RECORDS = f"""{_EVENTS}, records AS (
  SELECT user_id AS log_id, row_number() OVER (PARTITION BY user_id ORDER BY at_s, event_id) AS seq, event_type AS event, 'r' || event_id AS request_id,
    '<redacted:' || substr(sha256('u' || user_id), 1, 8) || '>' AS user_name, event_type AS type, printf('%.6f', at_s) AS ts, substr(sha256(event_id::VARCHAR), 1, 12) AS record_id FROM requests),
bodies AS (SELECT *, '{{"actor":"system","details":{{"type":"' || type || '","user_name":"' || user_name || '"}},"event":"' || event || '","prev_hash":"' AS head,
  '","record_id":"' || record_id || '","request_id":"' || request_id || '","ts":' || regexp_replace(regexp_replace(ts, '(\\.\\d*?)0+$', '\\1'), '\\.$', '.0') || '}}' AS tail FROM records),
sealed AS (
  SELECT log_id, seq, 'GENESIS' AS prev_hash, sha256(head || 'GENESIS' || tail) AS record_hash FROM bodies WHERE seq = 1
  UNION ALL SELECT b.log_id, b.seq, s.record_hash, sha256(b.head || s.record_hash || b.tail) FROM sealed s JOIN bodies b ON b.log_id = s.log_id AND b.seq = s.seq + 1)"""
_OBSERVED = "observed AS (SELECT round(value, 2) AS latency_ms, event_type = 'error' AS blocked, value > 100 AS needs_hitl, event_id % 50 AS tokens_in, event_id % 7 AS tokens_out FROM events)"
_METRICS = "metrics AS (SELECT count(*) AS requests_total, count(*) FILTER (blocked) AS requests_blocked, count(*) FILTER (needs_hitl) AS hitl_escalations, coalesce(avg(latency_ms), 0) AS latency_avg_ms, coalesce(sum(tokens_in), 0)::BIGINT AS tokens_in_total, coalesce(sum(tokens_out), 0)::BIGINT AS tokens_out_total FROM observed)"

_CASES = f"""{_TURNS},
judged0 AS (SELECT conv_id || '-' || turn AS id, question, answer, {_set('question', C.GROUND_STOP)} AS known, list_filter({_sents('answer')}, lambda s: {_words('s')} > 3) AS ss, ({_tok('question')})[1:2] AS must FROM turns),
judged1 AS (SELECT *, list_transform(ss, lambda s: {_ground('s', 'known')}) AS gs FROM judged0),
judged AS (SELECT id, question, answer, round_even({_mean('gs')}, 3) AS groundedness, len(list_filter(gs, lambda g: g < 0.2)) AS n_hallucinations,
    list_filter(must, lambda m: contains(lower(answer), lower(m))) AS hits, list_filter(must, lambda m: NOT contains(lower(answer), lower(m))) AS misses,
    list_filter(['the', 'zebra'], lambda m: contains(lower(answer), m)) AS forbidden FROM judged1),
cases AS (SELECT id, groundedness, (groundedness < 0.35)::BIGINT + len(misses) + len(forbidden) + (n_hallucinations > 0)::BIGINT AS n_failures, length(answer)::DOUBLE AS latency_ms,
    round_even(({_words('question')} * 0.5 + {_words('answer')} * 1.5)::DECIMAL(18, 1), 0)::DOUBLE / 1000000 AS cost_usd FROM judged)"""
_REPORT = "report AS (SELECT count(*) AS total, count(*) FILTER (n_failures = 0) AS passed, round_even(count(*) FILTER (n_failures = 0) / greatest(count(*), 1), 3)::DOUBLE AS pass_rate, round_even(sum(groundedness) / greatest(count(*), 1), 3)::DOUBLE AS avg_groundedness, round_even(sum(latency_ms) / greatest(count(*), 1), 1)::DOUBLE AS avg_latency_ms, round(sum(cost_usd), 6)::DOUBLE AS total_cost_usd FROM cases)"


def _exposition() -> str:
    from ..operators.service import EXPOSED

    lines = []
    for name, what, kind, column in EXPOSED:
        value = f"printf('%.1f', {column})" if kind == "gauge" else column
        lines += [_q(f"# HELP {name} {what}"), _q(f"# TYPE {name} {kind}"), f"{_q(name + ' ')} || {value}"]
    return " || chr(10) || ".join(lines) + " || chr(10)"


_RANKED_VECTORS = """pairs AS (SELECT q.vec_id AS qid, q.label AS q_label, v.vec_id, v.label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0),
top AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM pairs QUALIFY rank <= 10)"""


def _run_metrics() -> str:
    out = []
    for k in (1, 3, 5):
        out.append(f"round(avg(coalesce(len(list_filter(good[1:{k}], lambda x: x))::DOUBLE / nullif(len(good[1:{k}]), 0), 0)), 9) AS precision_at_{k}")
        out.append(f"round(avg(coalesce(len(list_filter(good[1:{k}], lambda x: x))::DOUBLE / nullif(len(list_filter(good, lambda x: x)), 0), 0)), 9) AS recall_at_{k}")
        out.append(f"round(avg(CASE WHEN list_contains(good[1:{k}], true) THEN 1.0 ELSE 0.0 END), 9) AS hit_rate_at_{k}")
    out.append("round(avg(coalesce(1.0 / nullif(list_position(good, true), 0), 0)), 9) AS mrr")
    return ", ".join(out)


def oracle_sql() -> dict[str, str]:
    index = f"WITH {_CHUNKS}, {_INDEX}"
    scan = f"WITH RECURSIVE {_pii()}"
    placed = f"{scan}, {_PLACED}"
    turns = f"WITH {_TURNS}"
    return {
        "term_postings": f"{index} SELECT term, chunk_ord, tf, dl FROM postings JOIN lengths USING (chunk_ord)",
        "term_dictionary": f"{index} SELECT term, df, round(idf, 9) AS idf FROM dictionary",
        # an index in storage, in segments, gives what one over all chunks gives
        "index_terms": f"{index} SELECT term, df, round(idf, 9) AS idf FROM dictionary",
        "bm25_postings": f"{index}, {_bm25(20)} SELECT qid, chunk_ord, round(score, 6) AS score, rank::INTEGER AS rank FROM bm25",
        "bm25_topk": f"{index}, {_bm25(20)} SELECT qid, chunk_ord, round(score, 6) AS score, rank::INTEGER AS rank FROM bm25",
        "hash_embed": f"WITH {_vectors('dv', 'doc_id', 'documents')} SELECT doc_id, bucket, round(w, 9) AS w FROM dv",
        "dense_topk": f"WITH {_CHUNKS}, {_DENSE} SELECT qid, chunk_ord, round(score, 6) AS score, rank::INTEGER AS rank FROM dense",
        "rrf_fusion": f"{index}, {_bm25(20)}, {_DENSE}, {_FUSED} SELECT qid, chunk_ord, round(fused, 9) AS fused, fused_rank::INTEGER AS fused_rank FROM fused",
        "rerank": f"{index}, {_bm25(20)}, cand AS (SELECT qid, chunk_ord, rank AS fused_rank FROM bm25), {_reranked('cand')} SELECT qid, chunk_ord, round(score, 9) AS score, rank::INTEGER AS rank FROM reranked",
        "hybrid_retrieve": f"{index}, {_bm25(20)}, {_DENSE}, {_FUSED}, {_reranked('fused')} SELECT qid, chunk_id, doc_id, text, round(score, 9) AS score, rank::INTEGER AS rank, 'reranked' AS source FROM reranked",
        "vector_topk": f"WITH {_RANKED_VECTORS} SELECT qid, vec_id, round(score, 6) AS score, rank FROM top",
        "vector_cosine": "SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding)::DOUBLE[]), 9) AS cosine FROM embeddings",
        "retrieval_metrics": f"WITH {_RANKED_VECTORS}, runs AS (SELECT qid, list(label = q_label ORDER BY rank) AS good FROM top GROUP BY qid) SELECT {_run_metrics()} FROM runs",
        "chunk_fixed": f"WITH {_CHUNKS} SELECT doc_id, idx, chunk_id, text, start, stop, 'fixed' AS strategy FROM ordered",
        "sentence_split": f"SELECT doc_id, (generate_subscripts(s, 1) - 1)::INTEGER AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_sents('text')} AS s FROM documents)",
        "sentence_line_split": f"SELECT doc_id, (generate_subscripts(s, 1) - 1)::INTEGER AS pos, unnest(s) AS sentence FROM (SELECT doc_id, {_sents('text', True)} AS s FROM documents)",
        "section_split": f"WITH {_SECTIONS} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY part) - 1)::INTEGER AS pos, section FROM whole WHERE section <> ''",
        "chunk_semantic": f"WITH RECURSIVE {_merged(1200, 200)} SELECT doc_id, i::INTEGER AS idx, doc_id || '#c' || i AS chunk_id, text, start::INTEGER AS start, stop::INTEGER AS stop, 'semantic' AS strategy FROM located WHERE i >= 0",
        "chunk_hierarchical": f"WITH RECURSIVE {_TREE} SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY i, s) - 1)::INTEGER AS ord, chunk_id, text, start::INTEGER AS start, stop::INTEGER AS stop, strategy, level, parent_id, parent_text, owner_id FROM tree",
        "parent_links": f"WITH RECURSIVE {_TREE} SELECT doc_id || '#c' || i AS pid, count(*) AS children, count(*) FILTER (contains(ptext, text)) AS inside FROM kids GROUP BY ALL",
        "pii_default_types": f"WITH RECURSIVE {_pii(C.PII_TYPES, {})}, counted AS (SELECT doc_id, entity_type, count(*) AS n FROM spans GROUP BY ALL) SELECT d.doc_id, coalesce(string_agg(entity_type || '=' || n, ',' ORDER BY entity_type), '') AS types FROM documents d LEFT JOIN counted USING (doc_id) GROUP BY d.doc_id",
        "chunk_stats": f"WITH {_CHUNKS} SELECT count(DISTINCT doc_id) AS documents, count(*) AS chunks FROM ordered",
        "chunk_lookup": f"WITH {_CHUNKS} SELECT chunk_id, doc_id, text FROM ordered WHERE chunk_id = '1#c0'",
        "input_guardrail": _input_guardrail(),
        "request_intent": f"SELECT conv_id, turn, {_intent('text')} AS intent FROM conversations",
        "pii_spans": f"{scan} SELECT doc_id, entity_type, start::INTEGER AS start, stop::INTEGER AS stop, span, confidence, detector FROM spans",
        "pii_counts": f"{scan} SELECT entity_type, count(*) AS n FROM spans GROUP BY entity_type",
        "pii_redact": f"{placed} SELECT doc_id, redacted FROM redacted",
        "pii_map": f"{placed} SELECT doc_id, placeholder, original FROM entries",
        "pii_seal": f"{placed} SELECT d.doc_id, sha256({_q(SALT + ':')} || coalesce(e.body, '')) AS seal FROM documents d LEFT JOIN (SELECT doc_id, string_agg(placeholder || '=' || original, '|' ORDER BY placeholder) AS body FROM entries GROUP BY doc_id) e USING (doc_id)",
        "pii_restore": "SELECT doc_id, coalesce(text, '') AS restored FROM documents",
        "leak_scan": f"{placed}, leaks AS (SELECT doc_id, regexp_extract(placeholder, '^\\[(.*)_', 1) AS kind, made FROM entries JOIN documents USING (doc_id) WHERE length(original) >= 4 AND contains(text, original)), kinds AS (SELECT doc_id, kind, max(made) AS made, count(*) AS n FROM leaks GROUP BY doc_id, kind) SELECT d.doc_id, coalesce(string_agg(kind, ',' ORDER BY made DESC), '') AS leaked, coalesce(sum(n), 0)::BIGINT AS n_leaked FROM documents d LEFT JOIN kinds USING (doc_id) GROUP BY d.doc_id",
        "leak_across": f"{placed}, originals AS (SELECT DISTINCT original FROM entries WHERE length(original) >= 4) SELECT doc_id, count(*) AS n_originals FROM originals JOIN (SELECT DISTINCT doc_id, text FROM documents) d ON contains(d.text, original) GROUP BY doc_id",
        "context_assembly": f"{index}, {_bm25(8)}, pieces AS (SELECT qid, rank, chunk_id, '[' || chunk_id || '] ' || text AS piece FROM bm25 JOIN ordered USING (chunk_ord)), totals AS (SELECT *, sum(length(piece)) OVER (PARTITION BY qid ORDER BY rank) AS total FROM pieces) SELECT qid, coalesce(string_agg(piece, chr(10) || chr(10) ORDER BY rank) FILTER (total <= 4000), '') AS context_text, string_agg(chunk_id, {_SEP} ORDER BY rank) AS citations FROM totals GROUP BY qid",
        "extractive_answer": f"{turns} SELECT conv_id, turn, {_extractive('question', 'answer')} AS reply FROM turns",
        "summarize": f"SELECT doc_id, {_summary('text')} AS summary FROM documents",
        "extract_fields": f"SELECT doc_id, {_fields('text')} AS fields FROM documents",
        "prompts": f"{turns} SELECT conv_id, turn, {_q(C.ANSWER_PROMPT + 'CONTEXT:' + chr(10))} || answer || chr(10) || chr(10) || 'QUESTION:' || chr(10) || question || chr(10) || chr(10) || 'ANSWER:' AS qa, {_q(C.SUMMARY_PROMPT + 'CONTEXT:' + chr(10))} || answer || chr(10) || chr(10) || 'SUMMARY:' AS summarize, {_q(C.EXTRACT_PROMPT + 'CONTEXT:' + chr(10))} || answer || chr(10) || chr(10) || 'EXTRACT:' AS extract FROM turns",
        "groundedness": f"{turns} SELECT conv_id, turn, round_even({_ground('answer', _set('question', C.GROUND_STOP))}, 6)::DOUBLE AS groundedness FROM turns",
        "output_guardrail": f"{turns}, {_checked('answer', 'question')} {_VERDICT}",
        "cited_guardrail": f"WITH {_TURNS.replace('turns AS', 'turns0 AS', 1)}, turns AS (SELECT conv_id, turn, answer, {_extractive('question', 'answer')} AS reply FROM turns0), {_checked('reply', 'answer')} {_VERDICT}",
        "respond_hitl": f"{turns}, {_checked('answer', 'question')} SELECT conv_id, turn, CASE WHEN len(issues) > 0 AND conv_id % 2 <> 0 THEN {_q(C.ESCALATED[0])} || array_to_string(issues, '; ') || {_q(C.ESCALATED[1])} ELSE {_disclaimed('a')} END AS final_answer FROM checked",
        "disclaimer": f"SELECT conv_id, turn, {_disclaimed('text')} AS final_text FROM conversations",
        "token_cost": f"{turns} SELECT conv_id, turn, {_words('question')} AS tokens_in, {_words('answer')} AS tokens_out, round(({_words('question')} * 0.5 + {_words('answer')} * 1.5)::DOUBLE / 1000000, 9) AS cost_usd FROM turns",
        "judge": f"WITH {_CASES} SELECT id, groundedness, n_hallucinations, coalesce(array_to_string(hits, ','), '') AS hits, coalesce(array_to_string(misses, ','), '') AS misses, coalesce(array_to_string(forbidden, ','), '') AS forbidden, true AS citation_hit FROM judged",
        "eval_cases": f"WITH {_CASES} SELECT id, groundedness, n_failures = 0 AS passed, n_failures, latency_ms, cost_usd FROM cases",
        "eval_report": f"WITH {_CASES}, {_REPORT} SELECT * FROM report",
        "regression_gate": f"WITH {_CASES}, {_REPORT}, tests AS (SELECT list_filter([CASE WHEN pass_rate < 0.8 THEN 'pass_rate < 0.8' END, CASE WHEN avg_groundedness < 0.4 THEN 'avg_groundedness < 0.4' END, CASE WHEN avg_latency_ms > 5000 THEN 'avg_latency_ms > 5000.0' END], lambda x: x IS NOT NULL) AS f FROM report) SELECT len(f) = 0 AS passed, coalesce(array_to_string(f, '; '), '') AS failures FROM tests",
        "audit_scrub": f"WITH RECURSIVE {_RECORDS} SELECT request_id, user_name, type FROM records",
        "audit_seal": f"WITH RECURSIVE {_RECORDS} SELECT log_id::VARCHAR AS log_id, seq, prev_hash, record_hash FROM sealed",
        # three batches, each behind the heads of the one before, are the chain as a whole
        "audit_append": f"WITH RECURSIVE {_RECORDS} SELECT log_id::VARCHAR AS log_id, seq, prev_hash, record_hash FROM sealed",
        "audit_details": """SELECT event_id, '{"large":' || (value > 20) || ',"props":' || replace(props, ' ', '') || ',"type":"' || event_type || '","user_name":"<redacted:' || substr(sha256('u' || user_id), 1, 8) || '>","users":[' || user_id || ',null],"value":' || value || '}' AS details FROM events""",
        "eval_audit": f"""WITH {_CASES} SELECT 'eval' AS log_id, split_part(id, '-', 1)::BIGINT * 1000 + split_part(id, '-', 2)::BIGINT AS seq, 'eval_case' AS event, 'eval-' || id AS request_id, 'eval-harness' AS actor,
          '{{"example_id":"' || id || '","groundedness":' || groundedness || ',"latency_ms":' || latency_ms || ',"passed":' || (n_failures = 0) || '}}' AS details, '0.0' AS ts FROM cases""",
        "audit_verify": f"""WITH RECURSIVE {_RECORDS},
          broken AS (SELECT log_id, CASE WHEN log_id % 10 = 0 THEN 3 ELSE 3 END AS seq, CASE WHEN log_id % 10 = 0 THEN 'record_hash mismatch' ELSE 'prev_hash mismatch' END AS reason, CASE WHEN log_id % 10 = 0 THEN 2 ELSE 1 END AS checked FROM (SELECT DISTINCT log_id FROM records) WHERE log_id % 10 IN (0, 1)),
          sizes AS (SELECT log_id, count(*) FILTER (NOT (log_id % 10 = 1 AND seq = 2)) AS n FROM records GROUP BY log_id)
          SELECT s.log_id::VARCHAR AS log_id, r.record_id IS NULL AS ok, CASE WHEN r.record_id IS NULL THEN n ELSE b.checked END AS checked, r.record_id AS broken_at, CASE WHEN r.record_id IS NOT NULL THEN b.reason END AS reason
          FROM sizes s LEFT JOIN broken b USING (log_id) LEFT JOIN records r ON r.log_id = s.log_id AND r.seq = b.seq""",
        "rate_limit": f"""WITH RECURSIVE {_EVENTS}, numbered AS (SELECT user_id, event_id, at_s / 60 AS t, row_number() OVER (PARTITION BY user_id ORDER BY at_s / 60, event_id) AS k FROM requests),
          fold AS (
            SELECT user_id, event_id, k, true AS allowed, [t] AS recent FROM numbered WHERE k = 1
            UNION ALL
            SELECT n.user_id, n.event_id, n.k, len(list_filter(f.recent, lambda x: n.t - x < 60)) < 10,
              CASE WHEN len(list_filter(f.recent, lambda x: n.t - x < 60)) < 10 THEN list_append(list_filter(f.recent, lambda x: n.t - x < 60), n.t) ELSE list_filter(f.recent, lambda x: n.t - x < 60) END
            FROM fold f JOIN numbered n ON n.user_id = f.user_id AND n.k = f.k + 1)
          SELECT user_id, event_id, allowed FROM fold""",
        "prompt_answer": f"""{turns}, modes AS (SELECT *, {_intent('question')} AS mode FROM turns),
          said AS (SELECT conv_id, turn, question, mode, CASE WHEN mode = 'qa' THEN {_strip('answer')} ELSE {_strip("answer || chr(10) || chr(10) || CASE mode WHEN 'summarize' THEN 'SUMMARY:' ELSE 'EXTRACT:' END")} END AS context, lower(question || chr(10) || answer) AS low FROM modes)
          SELECT conv_id, turn, CASE WHEN mode = 'summarize' OR contains(low, 'summarize') THEN {_summary('context')} WHEN mode = 'extract' OR contains(low, 'extract') THEN {_fields('context')} ELSE {_extractive(_strip('question'), 'context')} END AS reply FROM said""",
        "service_metrics": f"WITH {_OBSERVED}, {_METRICS} SELECT requests_total, requests_blocked, hitl_escalations, round(latency_avg_ms, 4) AS latency_avg_ms, tokens_in_total, tokens_out_total FROM metrics",
        "prometheus": f"WITH {_OBSERVED}, {_METRICS} SELECT {_exposition()} AS text FROM metrics",
        "sse_deltas": f"""WITH parts AS (SELECT conv_id || '-' || turn AS id, string_split(text, '. ') AS p FROM conversations WHERE role = 'assistant'),
          every AS (SELECT id, generate_subscripts(p, 1) - 1 AS seq, ', "delta": ' || {_json('unnest(p)')} AS rest FROM parts UNION ALL SELECT id, len(p), ', "done": true' FROM parts)
          SELECT id, seq::INTEGER AS seq, 'data: {{"request_id": "' || id || '"' || rest || '}}' || chr(10) || chr(10) AS frame FROM every""",
        "api_keys": f"WITH {_EVENTS} SELECT event_id, (user_id % 20) % 3 = 0 AS authorised FROM requests",
    }
