"""What the queries return, in DuckDB SQL over the same tables, where SQL can say it."""

from __future__ import annotations

from rillflow.llm.quality_rules import BASE, RULES, STOP_WORDS, SYMBOLS

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WS = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
LOWER = f"translate(coalesce(text, ''), '{UP}', '{LOW}')"
WORDS = r"list_filter(regexp_split_to_array({t}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"
TOKENS = r"list_filter(regexp_split_to_array({t}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

#: The checksum of zip files and Ethernet, byte by byte with its table.
CRC = """step(i, k, v) AS (SELECT i, 0, i::BIGINT FROM range(256) r(i) UNION ALL
 SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM step WHERE k < 8),
tab AS (SELECT list(v ORDER BY i) AS t FROM step WHERE k = 8),
crc AS (SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE xor(list_reduce(list_transform(range(0, strlen(text)), lambda i: ('0x' || substr(hex(encode(text)), 2 * i + 1, 2))::BIGINT),
 lambda a, y: xor(a >> 8, t[CAST(xor(a, y) & 255 AS INTEGER) + 1]), 4294967295::BIGINT), 4294967295) END AS crc FROM documents, tab)"""

OP1 = f"""WITH RECURSIVE {CRC},
d AS (SELECT doc_id, coalesce('s' || source, 'n') AS part, md5('shard:' || coalesce(doc_id::VARCHAR, 'null')) AS key, strlen(coalesce(text, '')) + 16 AS size FROM documents),
r AS (SELECT *, (2 * row_number() OVER (PARTITION BY part ORDER BY key) - 1) / (2 * count(*) OVER (PARTITION BY part))::DOUBLE AS frac FROM d),
p AS (SELECT *, row_number() OVER (ORDER BY frac, part, key) - 1 AS place, count(*) OVER () AS n FROM r)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(place * 40 // n AS INTEGER) AS shard,
 CAST(place - ((place * 40 // n) * n + 39) // 40 AS BIGINT) AS slot, NULL::INTEGER AS grown_shard FROM p JOIN crc USING (doc_id)"""

OP2 = """WITH c AS (SELECT coalesce('s' || source, 'n') AS part, count(*) AS n FROM documents GROUP BY ALL), s AS (SELECT sum(pow(n::DOUBLE, 0.5)) AS w, sum(n) AS t FROM c),
r AS (SELECT part, t * pow(n::DOUBLE, 0.5) / (w * n) AS rate FROM c, s), p AS (SELECT part, rate, greatest(ceil(rate / 8), 1) AS pieces FROM r),
j AS (SELECT unnest(range(0, 61)) AS j), f AS (SELECT part, j, sum(exp(-rate / pieces + j * ln(rate / pieces) - lgamma(j + 1))) OVER (PARTITION BY part ORDER BY j) AS c FROM p, j),
u AS (SELECT doc_id, source, coalesce('s' || source, 'n') AS part, unnest(range(1, pieces::BIGINT + 1)) AS piece FROM documents JOIN p ON p.part = coalesce('s' || source, 'n')),
v AS (SELECT *, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null') || ':' || piece), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS at FROM u),
k AS (SELECT doc_id, source, piece, count(*) AS k FROM v JOIN f ON f.part = v.part AND f.c <= v.at GROUP BY ALL),
t AS (SELECT doc_id, source, sum(k) AS times FROM k GROUP BY ALL), x AS (SELECT doc_id, source, unnest(range(1, times::BIGINT + 1)) AS copy FROM t)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, row_number() OVER (ORDER BY md5('mix-order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy)) - 1 AS place FROM x"""

OP5 = f"""WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents),
l AS (SELECT doc_id, x, list_transform(x, lambda v: translate(trim(v, {WS}), '{UP}', '{LOW}')) AS y FROM d),
f AS (SELECT key FROM (SELECT DISTINCT doc_id, unnest(y) AS key FROM l) WHERE length(key) >= 1 GROUP BY key HAVING count(*) >= 10),
u AS (SELECT doc_id, unnest(range(len(x))) AS i, unnest(x) AS line, unnest(y) AS key FROM l)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM u LEFT JOIN f ON f.key = u.key GROUP BY doc_id"""

OP7 = f"""WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format(t=LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(w, i, i + 4) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
b AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS shared FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT u, v FROM b JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
z AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, z.v FROM reach JOIN z ON z.u = reach.b),
c AS (SELECT a AS doc_id, min(b) AS root FROM reach GROUP BY a)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)"""


def _chars(chars: str) -> str:
    return f"length(t) - length(translate(t, '{chars}', ''))"


def _rule(r) -> str:
    right = f"{r.limit}" if r.right == "one" else f"{r.limit} * {r.right}"
    return f"{r.factor} * {r.left} {'>' if r.over else '<'} {right}"


STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
OP9 = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format(t="coalesce(text, '')")} AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, {WS}) <> '') AS l FROM documents),
g AS (SELECT doc_id, list_slice(w, i, i + 7) AS g, i FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
h AS (SELECT doc_id, unnest(i) AS i FROM (SELECT doc_id, g, list(i) AS i FROM g GROUP BY ALL HAVING count(*) > 1)),
r AS (SELECT doc_id, count(DISTINCT p) AS k FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(t, {WS}, '')) AS BIGINT) AS word_chars, CAST({_chars(SYMBOLS)} AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
 coalesce(k, 0) AS n_repeat_words, len(l) AS n_lines, {_chars(UP)} AS n_upper, len(list_filter(regexp_split_to_array(translate(t, '{UP}', '{LOW}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x IN ({STOPS}))) AS n_stop_words FROM d LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {' OR '.join(_rule(r) for r in RULES if r.name in BASE)} AS base_failed, NOT ({' OR '.join(_rule(r) for r in RULES)}) AS kept FROM m"""

OP10 = f"""WITH d AS (SELECT doc_id, {TOKENS.format(t=LOWER)} AS w FROM documents), b AS (SELECT item_id, {TOKENS.format(t=LOWER)} AS w FROM benchmark),
k AS (SELECT DISTINCT least(10, len(w)) AS k FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, list_slice(w, i, i + least(10, len(w)) - 1) AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, k, i, list_slice(w, i, i + k - 1) AS g FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k)),
h AS (SELECT doc_id, k, i, item_id FROM dw JOIN bw USING (g)),
p AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
q AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(p.n, 0) AS n_hit, coalesce(q.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated FROM d LEFT JOIN p USING (doc_id) LEFT JOIN q USING (doc_id)"""

def _field(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR) || ':' || {c}::VARCHAR END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


ID_CRC = """CASE WHEN doc_id IS NULL THEN 1 ELSE xor(list_reduce(list_transform(range(0, strlen(doc_id::VARCHAR)), lambda i: ascii(substr(doc_id::VARCHAR, i::INTEGER + 1, 1))::BIGINT),
 lambda a, y: xor(a >> 8, t[CAST(xor(a, y) & 255 AS INTEGER) + 1]), 4294967295::BIGINT), 4294967295) END"""

OP13 = f"""WITH RECURSIVE {CRC[: CRC.index(",\ncrc AS")]},
l AS (SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, CASE WHEN {ID_CRC} % 7 = 0 THEN {_leaf("(n_chars + 1)")} ELSE {_leaf("n_chars")} END AS found FROM documents, tab),
r AS (SELECT *, row_number() OVER () AS id, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM l),
tree AS (SELECT lang, 0 AS lv, pos, leaf AS d, n FROM r UNION ALL SELECT lang, lv + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (n + 1) // 2 FROM tree WHERE n > 1 GROUP BY lang, lv, n, pos // 2),
s AS (SELECT lang, d AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (SELECT 0 AS lv, pos, subroot AS d, n FROM s UNION ALL SELECT lv + 1, pos // 2, sha256(string_agg(d, '' ORDER BY pos)), (n + 1) // 2 FROM top WHERE n > 1 GROUP BY lv, n, pos // 2),
a AS (SELECT id, t.lv, (r.pos >> t.lv) % 2 AS side, b.d FROM r JOIN (SELECT DISTINCT lang, lv FROM tree WHERE n > 1) t ON t.lang IS NOT DISTINCT FROM r.lang
 LEFT JOIN tree b ON b.lang IS NOT DISTINCT FROM r.lang AND b.lv = t.lv AND b.pos = xor(r.pos >> t.lv, 1)),
c AS (SELECT id, 1000 + t.lv AS lv, (s.pos >> t.lv) % 2 AS side, b.d FROM r JOIN s ON s.lang IS NOT DISTINCT FROM r.lang, (SELECT DISTINCT lv FROM top WHERE n > 1) t
 LEFT JOIN top b ON b.lv = t.lv AND b.pos = xor(s.pos >> t.lv, 1)),
p AS (SELECT id, sha256(coalesce(string_agg(d, '' ORDER BY lv), '')) AS proof, list(CASE WHEN d IS NULL THEN 'N' WHEN side = 1 THEN 'L' || d ELSE 'R' || d END ORDER BY lv) AS steps FROM (FROM a UNION ALL FROM c) GROUP BY id),
f AS (SELECT doc_id, leaf, subroot, (SELECT d FROM top WHERE n = 1) AS root, coalesce(proof, sha256('')) AS proof_sha256,
 list_reduce(coalesce(steps, []), lambda x, y: sha256(CASE y[1] WHEN 'N' THEN x WHEN 'L' THEN y[2:] || x ELSE x || y[2:] END), found) AS folded_root
 FROM r JOIN s ON s.lang IS NOT DISTINCT FROM r.lang LEFT JOIN p USING (id))
SELECT *, folded_root = root AS verified FROM f"""

OP11 = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
 UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '\### Assistant: </turn> ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
 CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
 CAST(sum(16 + length(regexp_replace(role, '([\\<>])', '\\\1', 'g')) + length(regexp_replace(text, '(\\|</?turn)', '\\\1', 'g'))) AS BIGINT) AS formatted_chars FROM c GROUP BY conv_id"""

SQL = {
    "op1_interleaved_shards": OP1,
    "op2_poisson_mixture": OP2,
    "op5_line_dedup": OP5,
    "op7_minhash_near_dedup": OP7,
    "op9_quality_rules": OP9,
    "op10_decontamination": OP10,
    "op11_chat_format": OP11,
    "op13_merkle_manifest": OP13,
}
