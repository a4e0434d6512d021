"""SQL, as DuckDB reads it, for the queries of this subpackage that SQL can express.

The texts state the contracts plainly (windows joined on their words, links by counted
shingles, lines by their written-out variants), not what the operators do.
"""

from __future__ import annotations

from .quality import FALSE_REJECTIONS, LADDERS, RISK

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_FOLDED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NGRAM_JOIN = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_FOLDED)} AS p FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(p[i:i + 3], ' ') AS g FROM w, range(1, len(p) - 2) AS t(i) WHERE len(p) >= 4
  UNION ALL SELECT doc_id, array_to_string(p, ' ') FROM w WHERE len(p) BETWEEN 1 AND 3),
sizes AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS name FROM grams GROUP BY doc_id),
copies AS (SELECT name, count(*) AS n_copies FROM sizes GROUP BY name),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM sizes UNION SELECT reach.a, ways.b FROM reach JOIN ways ON reach.b = ways.a),
least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, w.doc_id) AS component_id, coalesce(n_copies, 1)::BIGINT AS n_copies
FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN copies USING (name) LEFT JOIN least ON w.doc_id = least.doc_id"""

REPEATED_BYTES = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
blocks AS (SELECT doc_id, k, substr(h, 800 * k + 1, 1598) AS b FROM d, range(0, length(h) // 800 + 1) AS t(k)),
windows AS (SELECT doc_id, 400 * k + j AS i, md5(substr(b, 2 * j + 1, 800)) AS g FROM blocks, range(0, 400) AS t(j) WHERE length(b) >= 2 * j + 800),
again AS (SELECT g FROM windows GROUP BY g HAVING count(*) > 1),
bad AS (SELECT doc_id, i FROM windows SEMI JOIN again USING (g)),
opened AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS f FROM bad),
numbered AS (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM opened),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS z FROM numbered GROUP BY doc_id, r),
gaps AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS p FROM spans),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS last, string_agg(substr(h, 2 * p + 1, 2 * (a - p)), '' ORDER BY a) AS kept FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
sha256(unhex(coalesce(kept || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)"""

EARLIER_PASSAGES = f"""WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS p FROM documents),
windows AS (SELECT doc_id, i, array_to_string(p[i:i + 12], ' ') AS g FROM w, range(1, len(p) - 11) AS t(i)),
earliest AS (SELECT g, min(doc_id) AS d FROM windows GROUP BY g),
bad AS (SELECT doc_id, i FROM windows JOIN earliest USING (g) WHERE d < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM bad, range(0, 13) AS t(k)),
words AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS x FROM w),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, len(p)::BIGINT AS n_words, (len(p) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""


def _quality() -> str:
    ratio = {
        "symbol_ratio": "CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0.0 END", "dup_line_ratio": "CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0.0 END",
        "repeat_ratio": "CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0.0 END", "long_words": "CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END",
        "short_words": "-CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0.0 END",
    }
    steps = len(next(iter(LADDERS.values())))
    ladder = {rule: "[" + ", ".join(f"{c}::DOUBLE" for c in cuts) + "]" for rule, cuts in LADDERS.items()}
    hit = " OR ".join(f"{rule} > {ladder[rule]}[i + 1]" for rule in LADDERS)
    tail = "list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p}))))".replace("{p}", f"{FALSE_REJECTIONS}::DOUBLE")
    failed = ", ".join(f"CASE WHEN {rule} > {ladder[rule]}[best + 1] THEN '{rule}' END" for rule in LADDERS)
    return rf"""WITH w AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_WORDS.format("text")} AS p, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
triples AS (SELECT doc_id, i, array_to_string(p[i:i + 2], ' ') AS g FROM w, range(1, len(p) - 1) AS t(i)),
again AS (SELECT doc_id, i FROM triples QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(0, 3) AS t(k) GROUP BY doc_id),
counted AS (SELECT doc_id, lang, len(p)::BIGINT AS n_words, length(array_to_string(p, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines FROM w LEFT JOIN repeated USING (doc_id)),
rated AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {", ".join(f"{sql} AS {rule}" for rule, sql in ratio.items())} FROM counted),
held AS (SELECT lang, list_filter(range(0, {steps}), lambda i: {hit})[1] AS first FROM rated WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)),
climbed AS (SELECT lang, i, count(*) AS n, count(*) FILTER (first <= i) AS k FROM held, range(0, {steps}) AS t(i) GROUP BY lang, i),
tested AS (SELECT lang, i, {tail} <= {RISK}::DOUBLE / (SELECT count(DISTINCT lang) FROM held) AS ok FROM climbed),
certified AS (SELECT lang, coalesce(min(i) FILTER (NOT ok), {steps}) - 1 AS best FROM tested GROUP BY lang),
judged AS (SELECT rated.*, CASE WHEN best >= 0 THEN array_to_string(list_filter([{failed}], lambda x: x IS NOT NULL), ',') ELSE '' END AS failed FROM rated LEFT JOIN certified ON rated.lang IS NOT DISTINCT FROM certified.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, failed, NOT base_failed AND failed = '' AS kept FROM judged"""


_LINE = r"trim(regexp_replace(lower(raw), '[ \t\x0B\f\r]+', ' ', 'g'), ' ')"
_SCRIPTS = r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]"
NEAR_LINES = rf"""WITH t AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents),
raws AS (SELECT doc_id, generate_subscripts(p, 1) AS i, unnest(p) AS raw FROM t),
lines AS (SELECT doc_id, i, raw, {_LINE} AS x FROM raws),
long AS (SELECT *, length(x) - length(replace(x, ' ', '')) + 1 AS n FROM lines WHERE x <> ''),
enough AS (SELECT doc_id, i, x, n FROM long WHERE n >= 3 OR (strlen(x) > length(x) AND len(regexp_extract_all(x, '{_SCRIPTS}')) >= 3)),
firsts AS (SELECT x, n, min(row(doc_id, i)) AS spot FROM enough GROUP BY ALL),
apart AS (SELECT x, spot, n, string_split(x, ' ') AS w FROM firsts WHERE n >= 8),
gaps AS (SELECT x, spot, array_to_string(list_concat(w[:k - 1], [chr(1)], w[k + 1:]), ' ') AS v FROM apart, range(1, n + 1) AS t(k)),
cuts AS (SELECT DISTINCT x, spot, array_to_string(list_concat(w[:k - 1], w[k + 1:]), ' ') AS v FROM apart, range(1, n + 1) AS t(k)),
pairs AS (
  SELECT a.x, b.spot FROM gaps a JOIN gaps b USING (v) WHERE a.x <> b.x
  UNION ALL SELECT a.x, b.spot FROM cuts a JOIN apart b ON a.v = b.x
  UNION ALL SELECT b.x, a.spot FROM cuts a JOIN apart b ON a.v = b.x),
keeps AS (SELECT x, min(spot) AS spot FROM (SELECT x, spot FROM firsts UNION ALL SELECT x, spot FROM pairs) GROUP BY x),
gone AS (SELECT doc_id, i FROM enough JOIN keeps USING (x) WHERE spot < row(doc_id, i)),
left_ AS (SELECT doc_id, string_agg(raw, chr(10) ORDER BY i) AS kept, count(*) AS n FROM raws ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(len(p), 0)::BIGINT AS n_lines, (coalesce(len(p), 0) - coalesce(n, 0))::BIGINT AS n_lines_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN left_ USING (doc_id)"""

_ARGUMENTS = """CASE n % 4
  WHEN 0 THEN '{"limit":' || CASE WHEN n % 3 = 0 THEN '"' || n || '"' ELSE n::VARCHAR END || CASE WHEN n % 5 <> 0 THEN ',"query":' || q ELSE '' END || '}'
  WHEN 1 THEN '{"expression":' || q || CASE WHEN n % 5 = 0 THEN ',"more":1' ELSE '' END || '}'
  WHEN 2 THEN CASE WHEN n % 5 = 0 THEN '[1]' ELSE '{"days":' || n || ',"metric":true,"place":' || q || '}' END
  ELSE '{"key":' || q || '}' END"""
_FAULT = """CASE n % 4
  WHEN 0 THEN CASE WHEN n % 5 = 0 THEN 'missing argument' WHEN n % 3 = 0 THEN 'wrong type' END
  WHEN 1 THEN CASE WHEN n % 5 = 0 THEN 'unknown argument' END
  WHEN 2 THEN CASE WHEN n % 5 = 0 THEN 'not an object' END
  ELSE 'unknown tool' END"""
CHATS = f"""WITH RECURSIVE said AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
asked AS (SELECT conv_id, turn, generate_subscripts(p, 1) - 1 AS i, unnest(p) AS x FROM (SELECT *, string_split(text, chr(10)) AS p FROM said WHERE role = 'user')),
calls AS (SELECT *, length(x) AS n, to_json(x)::VARCHAR AS q, 't' || turn || '.' || (CASE WHEN i % 5 = 4 THEN i - 1 ELSE i END) AS call_id, i % 5 = 4 AS second,
  list_filter([CASE WHEN i % 4 <> 0 THEN 't' || turn || '.' || (i - 1) END, CASE WHEN length(x) % 7 = 0 THEN 't' || turn || '.' || (i + 1) END], lambda a: a IS NOT NULL) AS after FROM asked),
known AS (SELECT conv_id, call_id, turn AS call_turn, i AS call_no FROM calls WHERE NOT second),
named AS (SELECT conv_id, call_id, unnest(after) AS needs FROM calls WHERE NOT second),
waits AS (SELECT DISTINCT named.* FROM named SEMI JOIN known k ON named.conv_id = k.conv_id AND named.needs = k.call_id),
lost AS (SELECT DISTINCT named.conv_id, named.call_id FROM named ANTI JOIN known k ON named.conv_id = k.conv_id AND named.needs = k.call_id),
paths AS (SELECT conv_id, call_id, call_id AS at, 0 AS level FROM known UNION SELECT p.conv_id, p.call_id, w.needs, p.level + 1 FROM paths p JOIN waits w ON p.conv_id = w.conv_id AND p.at = w.call_id WHERE p.level < 200),
levels AS (SELECT conv_id, call_id, max(level) AS level FROM paths GROUP BY ALL),
answers AS (SELECT conv_id, turn, text, 't' || (turn - 1) || '.' || (length(text) % 2) AS call_id FROM said WHERE role = 'assistant'),
made AS (
  SELECT conv_id, turn, 'message' AS kind, NULL AS call_no, NULL AS call_id, NULL AS call_turn, NULL AS result_turn, 0 AS level, NULL AS problem, turn AS order_turn, 0 AS order_kind,
    '{{"content":' || to_json(text)::VARCHAR || ',"role":' || to_json(role)::VARCHAR || '}}' AS json FROM said WHERE role NOT IN ('user', 'assistant')
  UNION ALL SELECT c.conv_id, c.turn, 'call', i, c.call_id, c.turn, CASE WHEN NOT second THEN a.turn END, CASE WHEN level < 200 THEN level ELSE 0 END,
    CASE WHEN second THEN 'duplicate id' WHEN level = 200 THEN 'cycle' WHEN lost.call_id IS NOT NULL THEN 'unknown call awaited' ELSE {_FAULT} END, c.turn, 1,
    '{{"arguments":' || {_ARGUMENTS} || ',"id":"' || c.call_id || '","name":"' || ['search', 'calculator', 'weather', 'lookup'][n % 4 + 1] || '","role":"assistant"}}'
    FROM calls c LEFT JOIN answers a ON a.conv_id = c.conv_id AND a.call_id = c.call_id LEFT JOIN levels l ON l.conv_id = c.conv_id AND l.call_id = c.call_id LEFT JOIN lost ON lost.conv_id = c.conv_id AND lost.call_id = c.call_id
  UNION ALL SELECT a.conv_id, a.turn, 'result', call_no, a.call_id, call_turn, a.turn, CASE WHEN level < 200 THEN level ELSE 0 END, CASE WHEN k.call_id IS NULL THEN 'no call' END, coalesce(call_turn, a.turn), 2,
    '{{"content":' || to_json(text)::VARCHAR || ',"role":"tool","tool_call_id":"' || a.call_id || '"}}'
    FROM answers a LEFT JOIN known k ON k.conv_id = a.conv_id AND k.call_id = a.call_id LEFT JOIN levels l ON l.conv_id = a.conv_id AND l.call_id = a.call_id)
SELECT conv_id, turn, kind, call_no::INT AS call_no, call_id, call_turn, result_turn, coalesce(level, 0)::INT AS level, problem, order_turn, json,
coalesce(coalesce(level, 0)::BIGINT * 4294967296 + call_no, -1)::BIGINT AS order_call, order_kind::INT AS order_kind FROM made"""

#: crc32 has no function there: each distinct text's bytes go through a table of 256, one step of the recursion a byte.
SPELLINGS = """WITH RECURSIVE steps AS (SELECT i, i::UBIGINT AS c, 0 AS k FROM range(256) AS t(i) UNION ALL SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384::UBIGINT) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8),
bytes AS (SELECT i, c FROM steps WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents WHERE text IS NOT NULL),
kinds AS (SELECT run, hex(encode(doc_id || ':' || run)) AS h, count(*) AS m, row_number() OVER () AS k FROM runs GROUP BY doc_id, run),
summed AS (
  SELECT k, h, 4294967295::UBIGINT AS c, 0 AS pos FROM kinds
  UNION ALL SELECT s.k, s.h, xor(s.c // 256, b.c), s.pos + 1 FROM summed s JOIN bytes b ON b.i = xor(s.c % 256, ('0x' || s.h[2 * s.pos + 1:2 * s.pos + 2])::UBIGINT) WHERE 2 * s.pos < length(s.h)),
crcs AS (SELECT k, xor(c, 4294967295::UBIGINT) AS c FROM summed WHERE 2 * pos = length(h)),
cut AS (SELECT m, CASE WHEN c % 97 = 0 THEN run[:(c % length(run))::BIGINT] || run[(c % length(run))::BIGINT + 2:] ELSE run END AS word FROM kinds JOIN crcs USING (k)),
words AS (SELECT word, sum(m)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(m) >= 3),
places AS (SELECT word, n, i, word[:i] AS a, word[i + 2:] AS b FROM words, range(0, length(word)) AS t(i)),
cuts AS (SELECT DISTINCT word, n, a || b AS less FROM places),
near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM places x JOIN places y USING (i, a, b) WHERE x.word <> y.word
  UNION ALL SELECT c.word, w.word, w.n FROM cuts c JOIN words w ON c.less = w.word
  UNION ALL SELECT w.word, c.word, c.n FROM cuts c JOIN words w ON c.less = w.word),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n, arg_min(other, (-other_n, other)) AS other FROM near GROUP BY word),
judged AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 2 * w.n THEN other END AS form, CASE WHEN best_n >= 2 * w.n THEN best_n END AS form_n FROM words w LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM judged UNION ALL SELECT walk.word, j.form FROM walk JOIN judged j ON walk.root = j.word WHERE j.form IS NOT NULL),
ends AS (SELECT walk.word, walk.root FROM walk JOIN judged j ON walk.root = j.word WHERE j.form IS NULL)
SELECT word, form, root, n, n_near::BIGINT AS n_near, form_n FROM judged JOIN ends USING (word)"""

INFILL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u, sha256('7:' || doc_id) AS h FROM documents),
drawn AS (SELECT *, len(u) AS n, ('0x' || h[1:8])::UBIGINT % (len(u) + 1) AS p, ('0x' || h[9:16])::UBIGINT % (len(u) + 1) AS q, ('0x' || h[25:32])::UBIGINT % 100 < 50 AS spm FROM t),
cut AS (SELECT *, array_to_string(u[:least(p, q)::BIGINT], '') AS a, array_to_string(u[least(p, q)::BIGINT + 1:greatest(p, q)::BIGINT], '') AS b, array_to_string(u[greatest(p, q)::BIGINT + 1:], '') AS c,
  text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') AS plain FROM drawn)
SELECT doc_id, n::BIGINT AS n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(a) END AS prefix_chars, CASE WHEN NOT plain THEN length(b) END AS middle_chars,
sha256(CASE WHEN plain THEN text WHEN spm THEN '<S>' || c || '<P>' || a || '<M>' || b ELSE '<P>' || a || '<S>' || c || '<M>' || b END) AS output_sha256, sha256(text) AS restored_sha256 FROM cut"""

SQL = {
    "op1_ngram_jaccard_join": NGRAM_JOIN, "op3_suffix_array_dedup": REPEATED_BYTES, "op4_substring_dedup": EARLIER_PASSAGES,
    "op6_quality_rules": _quality(), "op8_chat_formatting": CHATS, "op9_line_dedup": NEAR_LINES,
    "op11_spelling_variants": SPELLINGS, "op12_fill_in_middle": INFILL,
}
