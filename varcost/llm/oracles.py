"""DuckDB SQL with the same result as the queries of the corpus operators, where SQL can express it."""

from __future__ import annotations

EXACT_DEDUP = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM t WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id)
"""

LINE_DEDUP = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS p FROM d),
k AS (
  SELECT r, doc_id, p, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY r
"""

# Base32 of the 40 hex digits: four letters for each five digits.
WARC = """
WITH t AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h,
         min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first_id
  FROM pages
)
SELECT page_id, n AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + ((('0x' || substr(h, 5 * (i // 4)::INT + 1, 5))::INT >> (15 - 5 * (i % 4))::INT) & 31), 1)), '') AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM t
"""

DECONTAMINATION = """
WITH texts AS (
  SELECT 'd' AS kind, doc_id AS id, row_number() OVER () AS r, text FROM documents
  UNION ALL SELECT 'b', item_id, -row_number() OVER (), text FROM benchmark
),
w AS (
  SELECT kind, id, r, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM texts
),
s AS (
  SELECT DISTINCT kind, id, r, array_to_string(ws[i:i + 4], ' ') AS sh
  FROM (SELECT *, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
),
n AS (SELECT r, count(*) AS n_item FROM s WHERE kind = 'b' GROUP BY r)
SELECT a.id AS doc_id, b.id AS item_id, any_value(n_item) AS n_item, count(*) AS n_shared,
       count(*) / any_value(n_item) AS containment
FROM s a JOIN s b ON a.sh = b.sh AND a.kind = 'd' AND b.kind = 'b' JOIN n ON n.r = b.r
GROUP BY a.id, a.r, b.id, b.r
HAVING count(*) / any_value(n_item) >= 0.8
"""

# Bytes as pairs of hex digits; windows by their start, then gaps and islands of what they cover.
REPEATS = """
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, sha256(coalesce(text, '')) AS whole, hex(encode(coalesce(text, ''))) AS x FROM documents
),
w AS (
  SELECT r, p, md5(substr(x, 2 * p + 1, 400)) AS h
  FROM (SELECT r, x, unnest(range(0, length(x) // 2 - 199)) AS p FROM d WHERE length(x) >= 400)
),
dup AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY h) AS n FROM w) WHERE n > 1),
runs AS (
  SELECT r, min(p) AS a, max(p) + 200 AS b
  FROM (SELECT r, p, sum(CASE WHEN p <= prev + 200 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS g
        FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS prev FROM dup))
  GROUP BY r, g
),
gone AS (
  SELECT r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last_end,
         string_agg(piece, '' ORDER BY a) AS head
  FROM (SELECT runs.*, substr(x, 2 * coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) + 1,
                              2 * (a - coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0))) AS piece
        FROM runs JOIN d USING (r))
  GROUP BY r
)
SELECT doc_id, length(x) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
       CASE WHEN n_spans IS NULL THEN whole ELSE sha256(unhex(head || substr(x, 2 * last_end + 1))) END AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""


def _field(value: str) -> str:
    """A value with its byte count, or a dash for NULL."""
    return f"coalesce(strlen(({value})::varchar)::varchar || ':' || ({value})::varchar, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(f) for f in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


# Reflected CRC-32, a bit at a time.
_CRC = """xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::ubigint)),
  lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384::ubigint * (x & 1)))),
  4294967295::ubigint)"""


def _climb(name: str, start: str, nodes: str, same: str) -> str:
    """Rows climb from node to parent, gathering siblings; \"here\" has one child less than two at the root."""
    return f"""
{name} AS (
  {start}
  UNION ALL
  SELECT w.r, w.grp, w.i // 2, w.lvl + 1, w.proof || coalesce(s.h, ''),
         sha256(CASE WHEN s.h IS NULL THEN w.fold WHEN w.i % 2 = 1 THEN s.h || w.fold ELSE w.fold || s.h END)
  FROM {name} w
  JOIN {nodes} o ON {same.format("o")} AND o.lvl = w.lvl AND o.i = w.i AND o.c > 1
  LEFT JOIN {nodes} s ON {same.format("s")} AND s.lvl = w.lvl AND s.i = xor(w.i, 1)
)"""


MERKLE = f"""
WITH RECURSIVE leaves AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM (SELECT row_number() OVER () AS r, doc_id, lang, {_leaf("n_chars")} AS h,
               CASE WHEN {_CRC} % 7 = 0 THEN {_leaf("n_chars + 1")} ELSE {_leaf("n_chars")} END AS t
        FROM documents)
),
nodes AS (
  SELECT lang, 0 AS lvl, i, h, n AS c FROM leaves
  UNION ALL
  SELECT lang, lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (c + 1) // 2 FROM nodes WHERE c > 1 GROUP BY lang, lvl, i // 2, c
),
subroots AS (
  SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE c = 1
),
tops AS (
  SELECT 0 AS lvl, i, h, n AS c FROM subroots
  UNION ALL
  SELECT lvl + 1, i // 2, sha256(string_agg(h, '' ORDER BY i)), (c + 1) // 2 FROM tops WHERE c > 1 GROUP BY lvl, i // 2, c
),{_climb("ways", "SELECT r, lang AS grp, i, 0 AS lvl, '' AS proof, t AS fold FROM leaves", "nodes", "{0}.lang IS NOT DISTINCT FROM w.grp")},
ends AS (SELECT w.* FROM ways w JOIN nodes o ON o.lang IS NOT DISTINCT FROM w.grp AND o.lvl = w.lvl AND o.i = w.i AND o.c = 1),{_climb("on_top", "SELECT e.r, e.grp, s.i, 0 AS lvl, e.proof, e.fold FROM ends e JOIN subroots s ON s.lang IS NOT DISTINCT FROM e.grp", "tops", "TRUE")}
SELECT l.doc_id, l.h AS leaf, s.h AS subroot, top.h AS root, sha256(w.proof) AS proof_sha256, w.fold AS folded_root,
       w.fold = top.h AS verified
FROM leaves l
JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
JOIN on_top w ON w.r = l.r
JOIN tops top ON top.c = 1 AND top.lvl = w.lvl
"""

DIVERGENCE = """
WITH t AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
),
words AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM t
),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY ALL HAVING count(DISTINCT r) >= 10),
counts AS (SELECT lang, source, term, count(*) AS n FROM words SEMI JOIN kept USING (lang, term) GROUP BY ALL),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
sums AS (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL),
groups AS (
  SELECT lang, source, coalesce(s.n, 0) AS n FROM (SELECT DISTINCT lang, source FROM t) LEFT JOIN sums s USING (lang, source)
),
shares AS (
  SELECT lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::hugeint * (coalesce(c.n, 0) + 2)) // (g.n + 2 * l.v) AS p,
         1 + (1000000000::hugeint * (k.n + 2)) // (l.n + 2 * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
),
apart AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
),
parts AS (
  SELECT g.lang, g.source, 'pair' AS part, h.source AS item, coalesce(x.value, 0) AS value
  FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
  LEFT JOIN apart x ON x.lang = g.lang AND x.source = g.source AND x.item = h.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::bigint AS value, rank::int AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
WHERE part = 'pair' OR rank <= 10
"""

ORACLES = {
    "op2_exact_dedup": EXACT_DEDUP,
    "op4_line_dedup": LINE_DEDUP,
    "op7_warc": WARC,
    "op8_repeats": REPEATS,
    "op10_decontamination": DECONTAMINATION,
    "op11_merkle": MERKLE,
    "op13_divergence": DIVERGENCE,
}
