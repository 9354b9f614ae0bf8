"""DuckDB statements of results; written apart from the Spark code."""

from __future__ import annotations

from hostguard.llm.licenses import BASE, TEMPLATES

LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

EXACT_DEDUP = f"""
WITH d AS (SELECT doc_id, sha256({LOWERED}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM d"""

DECONTAMINATION = r"""
WITH iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
            FROM benchmark),
ig AS (SELECT item_id, list_distinct(list_transform(range(0, len(w) - least(len(w), 5) + 1),
                  lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS grams
       FROM iw WHERE len(w) > 0),
i AS (SELECT item_id, len(grams) AS n, unnest(grams) AS gram FROM ig),
dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w
       FROM documents WHERE text IS NOT NULL),
sizes AS (SELECT DISTINCT least(len(w), 5) AS k FROM iw WHERE len(w) > 0),
d AS (SELECT DISTINCT doc_id, unnest(list_transform(range(0, len(w) - k + 1),
             lambda j: array_to_string(w[j + 1 : j + k], ' '))) AS gram
      FROM dw, sizes WHERE len(w) >= k)
SELECT doc_id, item_id, count(*) AS n_shared, n AS n_shingles, count(*) / n AS containment
FROM d JOIN i USING (gram) GROUP BY doc_id, item_id, n HAVING count(*) * 100 >= n * 80"""


# Escaping adds one character per control string, however many backslashes it has.
CHAT = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
           UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, len(regexp_extract_all(text, '[<\[]\\*(?:\||/?s>|/?INST\])'))
              + len(regexp_extract_all(role, '[<\[]\\*(?:\||/?s>|/?INST\])')) AS escapes FROM c)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|turn|><|says|><|end|>') + length(role) + length(text) + escapes) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""

_ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _spans(kind: int, pattern: str, group: int) -> str:
    """Matches with their place: the lengths of the texts between them and of the matches, added up."""
    return f"""
    SELECT doc_id, {kind} AS kind, value, width,
           list_sum(list_transform(gaps[1:nth], lambda g: length(g)))
               + coalesce(list_sum(list_transform(found[1:nth - 1], lambda f: length(f))), 0) AS start
    FROM (SELECT doc_id, gaps, found, unnest(range(1, len(found) + 1)) AS nth, unnest(val) AS value,
                 unnest(list_transform(found, lambda f: length(f))) AS width
          FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found,
                       regexp_extract_all(text, '{pattern}', {group}) AS val,
                       regexp_split_to_array(text, '{pattern}') AS gaps FROM documents WHERE text IS NOT NULL))"""


SECRETS = (
    f"""
WITH raw AS ({_spans(0, _ASSIGN, 2)}
    UNION ALL {_spans(1, "AKIA[A-Z0-9]+", 0)}
    UNION ALL {_spans(2, "[0-9a-f]{24,}", 0)}),
runs AS ({_spans(3, "[A-Za-z0-9+/_=-]{20,}", 0)}),"""
    + r"""
judged AS (SELECT * FROM runs WHERE NOT (
    regexp_matches(value, '(?i)^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$')
    OR regexp_matches(value, '(^|=)(AKIA[A-Z0-9]{9}|[A-Za-z0-9+/]{30})EXAMPLE(KEY)?$')
    OR regexp_matches(value, '^[0-9_=/+-]+$') OR regexp_matches(value, '^([A-Za-z]+[_/=-]?)+$'))),
windows AS (SELECT doc_id, start, value, unnest(range(0, length(value) - 19)) AS i FROM judged),
high AS (SELECT doc_id, start, value, min(i) AS a, max(i) AS b
    FROM (SELECT *, substr(value, i + 1, 20) AS part FROM windows)
    WHERE NOT regexp_matches(substr(regexp_replace(value, 'example', '*******', 'gi'), i + 1, 20), '[*]')
      AND list_aggregate(string_split(part, ''), 'entropy')
          >= CASE WHEN regexp_full_match(part, '[0-9a-f]+|[0-9A-F]+') THEN 2.93 ELSE 3.63 END
    GROUP BY doc_id, start, value),
spans AS (SELECT doc_id, kind, start, start + width AS stop FROM raw
          WHERE kind = 2 OR kind = 0 AND length(value) >= 6 OR kind = 1 AND width >= 20
    UNION ALL SELECT doc_id, 3, start + a, start + b + 20 FROM high
              WHERE regexp_matches(substr(value, a + 1, b - a + 20), '[0-9]')),
told AS (SELECT *, ['assign', 'access', 'hex', 'entropy'][kind + 1] || ':' || CAST(start AS BIGINT) || ':'
                || CAST(stop AS BIGINT) AS t FROM spans)
SELECT doc_id, count(t) FILTER (kind = 0) AS n_assign, count(t) FILTER (kind = 1) AS n_access,
       count(t) FILTER (kind = 2) AS n_hex,
       sha256(coalesce(string_agg(t, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256,
       coalesce(string_agg(t, ',' ORDER BY start, kind), '') AS spans
FROM documents LEFT JOIN told USING (doc_id) GROUP BY doc_id"""
)

# Base32 of a SHA-1: 160 bits, five at a time.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
b AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes,
             list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                 CAST(('0x' || substr(hex, CAST(floor(i * 5 / 4) AS BIGINT) + 1, 2)) AS BIGINT) // (2 ** (3 - i * 5 % 4))::BIGINT % 32 + 1, 1)),
                 'string_agg', '') AS payload_digest
      FROM (SELECT page_id, html, hex || '0' AS hex FROM p))
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM b WINDOW w AS (PARTITION BY payload_digest)"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_KNOWN = ", ".join(
    f"({i}, '{label}', {str(i < len(BASE)).lower()}, lower('{text}'))" for i, (label, text) in enumerate([*BASE, *TEMPLATES])
)


def _grams(words: str, width: int) -> str:
    return f"list_transform(range(0, len({words}) - {width} + 1), lambda i: array_to_string({words}[i + 1 : i + {width}], ' '))"


LICENSES = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '{_WORD}') AS w FROM documents),
t0 AS (SELECT tid, label, base, regexp_extract_all(txt, '{_WORD}') AS w FROM (VALUES {_KNOWN}) v(tid, label, base, txt)),
t AS (SELECT *, len(w) AS n, CASE WHEN len(w) >= 8 THEN 4 ELSE least(len(w), 2) END AS k, len(w) * 20 // 100 AS slack FROM t0),
tg AS (SELECT tid, k, unnest(CASE WHEN k = 4 THEN {_grams('w', 4)} WHEN k = 2 THEN {_grams('w', 2)} ELSE w END) AS gram,
              unnest(range(0, n - k + 1)) AS j FROM t),
dg AS (SELECT r, 4 AS k, unnest({_grams('w', 4)}) AS gram, unnest(range(0, len(w) - 3)) AS i FROM d WHERE len(w) >= 4
       UNION ALL
       SELECT r, 2, unnest({_grams('w', 2)}), unnest(range(0, len(w) - 1)) FROM d WHERE len(w) >= 2),
vote AS (SELECT r, tid, i - j AS diag, j FROM dg JOIN tg USING (k, gram)),
strong AS (SELECT r, tid, diag, n, k, slack FROM vote JOIN t USING (tid) GROUP BY ALL HAVING count(*) * 4 >= n - k + 1),
step AS (SELECT *, coalesce(diag - lag(diag) OVER (PARTITION BY r, tid ORDER BY diag) > slack, false) AS apart FROM strong),
copy AS (SELECT *, sum(CAST(apart AS INT)) OVER (PARTITION BY r, tid ORDER BY diag) AS c FROM step),
cover AS (SELECT DISTINCT r, tid, c, n, diag, unnest(range(j, j + k)) AS p FROM copy JOIN vote USING (r, tid, diag)),
span AS (SELECT r, tid, c, min(diag + p) AS start, count(DISTINCT p) / n AS share FROM cover GROUP BY r, tid, c, n
         HAVING count(DISTINCT p) * 100 >= n * 80),
doc AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word,
               string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
               string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
        FROM span JOIN t USING (tid) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN doc USING (r)"""


def _rounds(rounds: int = 10) -> str:
    """Assignments and centroids of each round, one after the other."""
    steps = []
    for n in range(rounds + 1):
        steps.append(
            f"a{n} AS MATERIALIZED (SELECT r, min_by(c, (d, c)) AS c, min(d) AS d FROM (SELECT r, k{n}.c AS c, "
            f"CAST(list_sum(list_transform(list_zip(x.v, k{n}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d "
            f"FROM x, k{n}) GROUP BY r)"
        )
        if n < rounds:
            steps.append(
                f"s{n} AS MATERIALIZED (SELECT c, list(m ORDER BY j) AS v FROM (SELECT c, j, CAST((sum(e) - ((sum(e) % count(*)) + count(*)) "
                f"% count(*)) // count(*) AS BIGINT) AS m FROM (SELECT c, unnest(v) AS e, unnest(range(64)) AS j FROM a{n} JOIN x USING (r)) "
                f"GROUP BY c, j) GROUP BY c), k{n + 1} AS MATERIALIZED (SELECT c, coalesce(s{n}.v, k{n}.v) AS v FROM k{n} LEFT JOIN s{n} USING (c))"
            )
    return ",\n".join(steps)


CLUSTERS = f"""
WITH x AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda e: CAST(floor(1024 * CAST(e AS DOUBLE)) AS BIGINT)) AS v
           FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || vec_id) AS h, v FROM x ORDER BY h, v LIMIT 8)),
{_rounds()}
SELECT vec_id, CAST(c AS INT) AS cluster, d AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(k10.v, ',')) AS centroid_sha256
FROM a10 JOIN x USING (r) JOIN k10 USING (c)"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
RANKED = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, '{_TERM}') AS t FROM documents),
i AS (SELECT item_id, unnest(regexp_extract_all({LOWERED}, '{_TERM}')) AS term FROM benchmark),
q AS (SELECT item_id, term, count(*) AS times FROM i GROUP BY ALL),
s AS (SELECT count(*) AS n_docs, sum(len(t)) AS total FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, len(t) AS n, term, count(*) AS tf FROM (SELECT r, doc_id, t, unnest(t) AS term FROM d)
      WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY term, n_docs),
g AS (SELECT item_id, r, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // total)))) AS BIGINT) AS score
      FROM p JOIN w USING (term) JOIN q USING (term), s GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
FROM g WHERE score > 0 QUALIFY rank <= 10"""
