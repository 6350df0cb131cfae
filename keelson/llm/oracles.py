"""DuckDB SQL of the queries that SQL can express.

The others are tested against brute-force versions in ``tests/llm``: mixing and
sharding (Spark's 64-bit hash and CRC-32 are not in DuckDB), and what is trained
(toxicity, personal data, URL filter), and fingerprints.
"""

from __future__ import annotations

from keelson.llm import chat, decontam, near_dups, negatives, quality, search

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _lower(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}')"


def _escaped(column: str) -> str:
    return f"replace(replace(replace({column}, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\t')"


OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS.format(_lower('text'))} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
        ELSE list_transform(range(1, greatest(1, len(w) - {near_dups.WIDTH - 1}) + 1),
                            lambda i: array_to_string(w[i:i + {near_dups.WIDTH - 1}], ' ')) END) AS g FROM d),
n AS (SELECT d.doc_id, count(g) AS n FROM d LEFT JOIN s USING (doc_id) GROUP BY ALL),
link AS (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE {near_dups.DEN} * shared >= {near_dups.NUM} * (p.n + q.n - shared)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS component_id FROM n"""

OP4 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{chat.PROBE}' UNION ALL SELECT -7, 1, 'assistant', '{chat.PROBE}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('### : </turn>') + 1 + length(replace({_escaped('role')}, ':', '\\c')) + length({_escaped('text')})) AS BIGINT)
         AS formatted_chars
FROM t GROUP BY conv_id"""

_CHARS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {k}) & 31), 1)" for k in (15, 10, 5, 0))
OP5 = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
least_ AS (SELECT html, min(page_id) AS m FROM p GROUP BY html)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(list_transform(range(8), lambda j: CAST('0x' || substr(hex, CAST(5 * j + 1 AS INTEGER), 5) AS BIGINT)),
                                      lambda v: {_CHARS}), '') AS payload_digest,
       CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> m THEN m END AS refers_to
FROM p JOIN least_ USING (html)"""

_TOKENS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_W = decontam.WINDOW
OP8 = f"""
WITH d AS (SELECT doc_id, {_TOKENS.format(_lower('text'))} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_TOKENS.format(_lower('text'))} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), {_W}) AS n, array_to_string(w[pos:pos + {_W - 1}], ' ') AS g
       FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {_W - 1}) + 1)) AS pos FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, pos, n, array_to_string(w[pos:pos + n - 1], ' ') AS g
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM d, (SELECT DISTINCT n FROM iw))),
hit AS (SELECT doc_id, pos, dw.n, item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM hit) GROUP BY ALL),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS l
        FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY ALL)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(l, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN ids USING (doc_id)"""


def _js(p: str, q: str) -> str:
    """Jensen-Shannon distance of two lists of counts."""
    share = lambda x: f"list_transform({x}, lambda v: v / CAST(list_sum({x}) AS DOUBLE))"
    term = lambda v, m: f"CASE WHEN {v} > 0 THEN {v} * log2({v} / {m}) ELSE 0 END"
    pairs = f"list_zip({share(p)}, {share(q)})"
    m = "((z[1] + z[2]) / 2)"
    return (f"CASE WHEN list_sum({p}) = 0 OR list_sum({q}) = 0 THEN 0.0 ELSE"
            f" sqrt(greatest(0.0, list_sum(list_transform({pairs}, lambda z: ({term('z[1]', m)} + {term('z[2]', m)}) / 2)))) END")


_LISTS = "CASE lang " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in quality.COMMON_WORDS.items()) + " ELSE [''] END"
_KNOWN = ", ".join(f"'{k}'" for k in quality.COMMON_WORDS)
_COUNTS = ", ".join("length(regexp_replace(t, '[^" + p.strip("[]").replace("'", "''") + "]', '', 'g'))" for p in quality.CHAR_CLASSES.values())
_SUMS = lambda col, n: "[" + ", ".join(f"coalesce(sum({col}[{k}]), 0)" for k in range(1, n + 1)) + "]"
_N_CHARS, _N_WORDS = len(quality.CHAR_CLASSES) + 3, max(map(len, quality.COMMON_WORDS.values())) + 1
_NONE = "[" + "0, " * (_N_WORDS - 1) + "1]"  # no listed word
OP9 = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CASE WHEN lang IN ({_KNOWN}) THEN lang ELSE 'other' END AS lang, {_LISTS} AS common,
                  {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
g AS (SELECT doc_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY ALL),
f AS (SELECT doc_id, lang, length(t) AS chars, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
             [{_COUNTS}] AS classes, strlen(t) - length(t) AS extra,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
             list_transform(common, lambda c: len(list_filter(w, lambda x: x = c))) AS seen FROM d),
h AS (SELECT *, classes || [chars - word_chars, extra, word_chars - list_sum(classes)] AS hc,
             seen || [n_words - list_sum(seen)] AS hw FROM f),
b AS (SELECT *, n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed FROM h LEFT JOIN rep USING (doc_id)),
r AS (SELECT lang, {_SUMS('hc', _N_CHARS)} AS rc, {_SUMS('hw', _N_WORDS)} AS rw FROM b WHERE NOT base_failed GROUP BY lang),
rn AS (SELECT *, CASE WHEN 1 - rw[{_N_WORDS}] / list_sum(rw) >= {quality.MIN_COMMON_SHARE} THEN {quality.MAX_WORD_SHARE} * {_js(_NONE, 'rw')} END AS cutoff FROM r),
j AS (SELECT *, coalesce({_js('hc', 'rc')}, 0.0) AS dc, CASE WHEN lang = 'other' THEN 0.0 ELSE coalesce({_js('hw', 'rw')}, 0.0) END AS dw
      FROM b LEFT JOIN rn USING (lang))
SELECT doc_id, n_words, word_chars, CAST(classes[4] AS BIGINT) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
       coalesce(n_repeat_words, 0) AS n_repeat_words, round(dc, 6) AS char_distance, round(dw, 6) AS word_distance, base_failed,
       NOT base_failed AND NOT ((chars >= {quality.MIN_CHARS} AND dc > {quality.MAX_CHAR_DISTANCE})
                                OR (n_words >= {quality.MIN_WORDS} AND coalesce(dw > cutoff, false))) AS kept
FROM j"""

_W11 = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_W11.format(_lower('text'))} AS w FROM documents),
c AS (SELECT count(*) AS docs, sum(len(w))::BIGINT AS terms FROM d WHERE len(w) > 0),
t AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY ALL),
f AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM t, c GROUP BY term, docs),
q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_W11.format(_lower('text'))}) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, r, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * len(w) * docs) // terms)))) AS BIGINT) AS score
      FROM q JOIN f USING (term) JOIN t USING (term) JOIN d USING (r), c GROUP BY ALL),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= {search.K}"""

_N = negatives
OP12 = f"""
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id,
             CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % {_N.ANCHOR_EVERY} = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS k FROM s WHERE same) WHERE k <= {_N.POSITIVES}),
n AS (SELECT anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
             CAST(row_number() OVER (PARTITION BY anchor_id, p.id ORDER BY s.score DESC, s.id) AS INTEGER) AS rank
      FROM p JOIN s USING (anchor_id)
      WHERE NOT s.same AND {_N.LOW} * p.score <= {_N.OF} * s.score AND {_N.OF} * s.score <= {_N.HIGH} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {_N.NEGATIVES}"""

SQL: dict[str, str] = {"op2_ngram_join": OP2, "op4_chat_format": OP4, "op5_warc": OP5, "op8_decontaminate": OP8, "op9_quality_rules": OP9,
                       "op11_ranked_search": OP11, "op12_hard_negatives": OP12}
