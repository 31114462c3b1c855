"""DuckDB SQL of the operators whose whole result SQL can state.

Each is written apart from the Spark side: plain scans, joins and windows
over the same tables.
"""

from __future__ import annotations

from shopflow.llm import licenses, secrets
from shopflow.llm.warc import LEAST_DUPLICATE, _EPOCH

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


WARC = fr"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha256(html) AS digest,
             regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)), '^www\.', '') AS host,
             regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS rest,
             strftime(TIMESTAMP '1970-01-01' + to_seconds(CAST({_EPOCH} + page_id % 31536000 AS BIGINT)), '%Y-%m-%dT%H:%M:%SZ') AS captured
      FROM p),
f AS (SELECT digest, min(page_id) AS first FROM d WHERE n >= {LEAST_DUPLICATE} GROUP BY digest HAVING count(*) > 1),
r AS (SELECT d.page_id, d.n AS payload_bytes, d.digest AS payload_digest,
             CASE WHEN f.first <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
             CASE WHEN f.first <> d.page_id THEN f.first END AS refers_to,
             lower(array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest = '' THEN '/' ELSE rest END) AS url_key,
             captured
      FROM d LEFT JOIN f ON d.digest = f.digest)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, record_type, refers_to, url_key, captured,
       row_number() OVER (ORDER BY url_key, captured, page_id) - 1 AS capture_no
FROM r"""

JACCARD = fr"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS shingle
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (SELECT a AS doc_id, a AS other FROM l UNION SELECT r.doc_id, l.b FROM reach r JOIN l ON l.a = r.other),
m AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.doc_id = d.doc_id"""


def licenses_sql() -> str:
    rows = []
    for number, (label, phrase, base) in enumerate([(*b, 1) for b in licenses.BASE] + [(*t, 0) for t in licenses.TEMPLATES]):
        words = phrase.split()
        rows += [f"({number}, {_text(label)}, {base}, {len(words)}, {i}, {_text(' '.join(words[i:i + 3]))})" for i in range(len(words) - 2)]
    return fr"""
WITH t(template, label, base, size, bit, gram) AS (VALUES {', '.join(rows)}),
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
      FROM documents),
g AS (SELECT doc_id, i - 1 AS position, array_to_string(w[i:i + 2], ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w WHERE len(w) >= 3)),
v AS (SELECT doc_id, template, label, base, size, position - bit AS diagonal, count(DISTINCT bit) AS votes
      FROM g JOIN t ON g.gram = t.gram GROUP BY 1, 2, 3, 4, 5, 6),
b AS (SELECT doc_id, label, diagonal FROM v WHERE base = 1 AND votes = size - 2),
x AS (SELECT g.doc_id, t.template, t.label, t.size, t.bit, g.position, g.position - t.bit AS diagonal FROM g JOIN t ON g.gram = t.gram WHERE t.base = 0),
y AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) <= {licenses.NEAR} THEN 0 ELSE 1 END AS fresh
      FROM (SELECT DISTINCT doc_id, template, diagonal FROM x)),
z AS (SELECT doc_id, template, diagonal, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS span FROM y),
m AS (SELECT x.doc_id, x.template, x.label, x.size, z.span, count(DISTINCT x.bit) AS votes, min(x.position) AS first, max(x.position) + 2 AS last
      FROM x JOIN z ON x.doc_id = z.doc_id AND x.template = z.template AND x.diagonal = z.diagonal GROUP BY 1, 2, 3, 4, 5),
o AS (SELECT doc_id, label, share FROM (SELECT *, votes / CAST(size - 2 AS DOUBLE) AS share FROM m) WHERE share >= {licenses.LEAST_SHARE} AND last - first + 1 <= {licenses.MOST_ROOM} * size + {licenses.NEAR}),
bb AS (SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, array_to_string(list_sort(list(DISTINCT label)), ',') AS base_labels FROM b GROUP BY doc_id),
ll AS (SELECT doc_id, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(share) AS score
       FROM (SELECT doc_id, label, 1.0 AS share FROM b UNION ALL SELECT doc_id, label, share FROM o) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM w LEFT JOIN bb ON bb.doc_id = w.doc_id LEFT JOIN ll ON ll.doc_id = w.doc_id"""


def secrets_sql() -> str:
    kinds = []
    for number, (name, pattern, group, least_value, least_match, _) in enumerate(secrets.KINDS):
        p = _text(pattern)
        kinds.append(f"""
SELECT doc_id, owner, repository, {number} AS kind, {_text(name)} AS name, s AS start, s + length(m) AS "end", v AS value FROM (
  SELECT doc_id, owner, repository, unnest(m) AS m, unnest(v) AS v,
         unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS s
  FROM (SELECT doc_id, source AS owner, lang AS repository, string_split_regex(t, {p}) AS p, regexp_extract_all(t, {p}) AS m, regexp_extract_all(t, {p}, {group}) AS v
        FROM (SELECT doc_id, source, lang, coalesce(text, '') AS t FROM documents) WHERE regexp_matches(t, {p})))
WHERE length(v) >= {least_value} AND length(m) >= {least_match}""")
    joined = "string_agg(name || ':' || start || ':' || \"end\", ',' ORDER BY start, kind, \"end\")"
    return f"""
WITH f AS ({' UNION ALL '.join(kinds)}),
o AS (SELECT value, count(DISTINCT coalesce(owner, chr(1))) AS owners, count(*) AS places,
             count(DISTINCT coalesce(owner, chr(1)) || chr(2) || coalesce(repository, chr(1))) AS repositories FROM f GROUP BY value),
j AS (SELECT f.*, owners, repositories, places, owners >= {secrets.COPIED_OWNERS} OR repositories >= {secrets.COPIED_REPOSITORIES} AS copied,
             NOT (owners >= {secrets.COPIED_OWNERS} OR repositories >= {secrets.COPIED_REPOSITORIES}) AND NOT regexp_matches(lower(f.value), 'example|changeme|placeholder|xxxx|0000000|1234567')
             AND len(list_distinct(string_split(f.value, ''))) >= {secrets.LEAST_VARIETY} AS live
      FROM f JOIN o ON o.value = f.value),
a AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
             string_agg(name || ':' || start || ':' || "end", ',' ORDER BY start, kind, "end") FILTER (kind < 3) AS base, {joined} AS spans,
             count(*) FILTER (live) AS n_live, count(*) FILTER (copied) AS n_copied,
             max(owners) AS owners, max(repositories) AS repositories, max(places) AS places
      FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied,
       coalesce(owners, 0) AS owners, coalesce(repositories, 0) AS repositories, coalesce(places, 0) AS places
FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id"""


SEARCH = fr"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
           FROM documents),
h AS (SELECT row, doc_id, len(terms) AS n, terms FROM d WHERE len(terms) > 0),
c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM h),
i AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
      FROM benchmark),
f AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM h) GROUP BY row, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM f, c GROUP BY term, docs),
s AS (SELECT item_id, row, CAST(sum(w.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length)))) AS BIGINT) AS score
      FROM i JOIN f ON f.term = i.term JOIN w ON w.term = i.term JOIN h USING (row), c GROUP BY item_id, row),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST) AS rank, doc_id, score
      FROM s JOIN h USING (row) WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10"""

CHAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, x.i, x.r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) x(i, r)),
e AS (SELECT *, replace(replace(replace(replace(text, '\', '\\'), '##', '#\#'), '##', '#\#'), '</turn>', '<\/turn>') AS body FROM t),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n,
             5 + length(replace(url_encode(role), '%20', '+')) + 1 + length(body) + 8 AS size FROM e),
p AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM o)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars,
       count(*) FILTER (role = 'assistant' OR i = n) AS n_examples
FROM p GROUP BY conv_id"""

_LEAF = "sha256(" + " || ".join(f"coalesce(CAST(octet_length(encode(CAST({{{c}}} AS VARCHAR))) AS VARCHAR) || ':' || CAST({{{c}}} AS VARCHAR), '-')" for c in ("d", "s", "l", "n", "t")) + ")"


def _leaf(text: str) -> str:
    return _LEAF.format(d="doc_id", s="source", l="lang", n="n_chars", t=text)


_BITS = "flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_transform(range(0, 8), lambda i: CAST((ord(c) >> i) & 1 AS BIGINT))))"

MANIFEST = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_leaf('text')} AS leaf, {_leaf("replace(text, chr(10), '')")} AS stripped,
         xor(list_reduce({_BITS}, lambda c, b: xor(c >> 1, (xor(c, b) & 1) * 3988292384), CAST(4294967295 AS BIGINT)), 4294967295) AS crc
  FROM documents),
l AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS s, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r FROM d),
sub AS (
  SELECT s, 0 AS h, r AS p, leaf AS digest, count(*) OVER (PARTITION BY s) AS n FROM l
  UNION ALL
  SELECT s, h + 1, p // 3, sha256(string_agg(digest, '' ORDER BY p)), max((n + 2) // 3) FROM sub WHERE n > 1 GROUP BY s, h, p // 3),
heads AS (SELECT s, digest, h FROM sub WHERE n = 1),
top AS (
  SELECT 0 AS h, s AS p, digest, count(*) OVER () AS n FROM heads
  UNION ALL
  SELECT h + 1, p // 3, sha256(string_agg(digest, '' ORDER BY p)), max((n + 2) // 3) FROM top WHERE n > 1 GROUP BY h, p // 3),
steps AS (
  SELECT l.s, l.r, sub.h, l.r // CAST(pow(3, sub.h) AS BIGINT) % 3 AS digit, sub.digest, sub.p % 3 AS place
  FROM l JOIN sub ON sub.s = l.s AND sub.n > 1 AND sub.p // 3 = l.r // CAST(pow(3, sub.h + 1) AS BIGINT)
  UNION ALL
  SELECT l.s, l.r, heads.h + top.h, l.s // CAST(pow(3, top.h) AS BIGINT) % 3, top.digest, top.p % 3
  FROM l JOIN heads ON heads.s = l.s JOIN top ON top.n > 1 AND top.p // 3 = l.s // CAST(pow(3, top.h + 1) AS BIGINT)),
sides AS (
  SELECT s, r, h, coalesce(string_agg(digest, '' ORDER BY place) FILTER (place < digit), '') AS a,
         coalesce(string_agg(digest, '' ORDER BY place) FILTER (place > digit), '') AS b
  FROM steps GROUP BY s, r, h),
fold AS (
  SELECT s, r, 0 AS h, CASE WHEN crc % 2 = 0 THEN stripped ELSE leaf END AS digest FROM l
  UNION ALL
  SELECT f.s, f.r, f.h + 1, sha256(x.a || f.digest || x.b) FROM fold f JOIN sides x ON x.s = f.s AND x.r = f.r AND x.h = f.h),
ended AS (SELECT s, r, arg_max(digest, h) AS digest FROM fold GROUP BY s, r),
proof AS (SELECT s, r, string_agg(a || b, '' ORDER BY h) AS path FROM sides GROUP BY s, r)
SELECT l.doc_id, l.leaf, heads.digest AS subroot, top.digest AS root, sha256(coalesce(proof.path, '')) AS proof_sha256,
       ended.digest AS folded_root, ended.digest = top.digest AS verified
FROM l JOIN heads ON heads.s = l.s JOIN top ON top.n = 1 JOIN ended ON ended.s = l.s AND ended.r = l.r
LEFT JOIN proof ON proof.s = l.s AND proof.r = l.r"""


ORACLE_SQL: dict[str, str] = {
    "op1_warc_index_merge": WARC,
    "op2_license_diagonals": licenses_sql(),
    "op3_ngram_jaccard_join": JACCARD,
    "op6_secret_ownership": secrets_sql(),
    "op11_fptree_search": SEARCH,
    "op12_manifest_descent": MANIFEST,
    "op13_prefix_target_chat": CHAT,
}
