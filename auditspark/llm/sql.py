"""SQL of operators 11 to 13, for an oracle."""

from __future__ import annotations


def _round(k: int) -> str:
    """Assignment to the codebooks b{k}, and codebooks b{k + 1}: means go down, unused entries stay."""
    return f"""
a{k} AS MATERIALIZED (SELECT r, p, min(struct_pack(d := d, e := e)) AS m FROM (SELECT part.r, part.p, b.e, CAST(list_sum(list_transform(list_zip(part.v, b.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM part JOIN b{k} b USING (p)) GROUP BY ALL),
m{k} AS (SELECT p, e, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY i) AS v FROM (SELECT a.p, a.m.e AS e, i, CAST(sum(part.v[i]) AS BIGINT) AS s, count(*) AS n FROM a{k} a JOIN part USING (r, p), LATERAL (SELECT unnest(range(1, len(part.v) + 1)) AS i) GROUP BY ALL) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.v, b.v) AS v FROM b{k} b LEFT JOIN m{k} m USING (p, e)),"""


CODES_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS r, vec_id, label, embedding FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
part AS MATERIALIZED (SELECT r, p, list_transform(embedding[p * w + 1:(p + 1) * w], lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM (SELECT r, embedding, len(embedding) // 16 AS w, unnest(range(16)) AS p FROM kept)),
b0 AS MATERIALIZED (SELECT p, r - 1 AS e, v FROM part WHERE r <= 64),{_round(0)}{_round(1)}{_round(2)[:_round(2).index("m2 AS")]}
each AS (SELECT r, string_agg(lpad(to_hex(m.e), 2, '0'), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM a2 GROUP BY 1),
book AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) AS h FROM b2)
SELECT vec_id, lower(code) AS code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM kept JOIN each USING (r), book
"""

_RULES = {
    "short": "n_words < 50", "repetitive": "100 * n_repeat_words > 50 * n_words", "symbols": "10 * n_symbols > n_words",
    "copied_lines": "n_dup_lines > 0 AND 10 * n_dup_lines > n_words", "word_length": "n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words)",
}


def _bad(r: str) -> str:
    rate = f"((f_{r} + m_{r} * c_{r}) / (n + c_{r}))"
    return f"({rate} > 0.5 AND {rate} - m_{r} > 3 * sqrt({rate} * (1 - {rate}) / (n + c_{r} + 1)))"


HOSTS_SQL = (
    r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, i, md5(array_to_string(w[i:i + 2], ' ')) AS h FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, h) AS k FROM win) WHERE k > 1),
cover AS (SELECT r, count(DISTINCT i + o) AS n FROM again, (SELECT unnest([0, 1, 2]) AS o) GROUP BY 1),
rows_ AS MATERIALIZED (SELECT d.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cover.n, 0) AS BIGINT) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d) d LEFT JOIN cover USING (r)),
hosts AS MATERIALIZED (SELECT source, count(*) AS n, """
    + ", ".join(f"count(*) FILTER (WHERE {t}) AS f_{r}" for r, t in _RULES.items())
    + """ FROM rows_ GROUP BY 1),
sums AS (SELECT count(*) AS k, sum(n) AS n, sum(n::DOUBLE * n) AS nn, """
    + ", ".join(f"sum(f_{r}) AS s_{r}, sum(f_{r}::DOUBLE * f_{r} / n) AS q_{r}" for r in _RULES)
    + """ FROM hosts),
moments AS (SELECT """
    + ", ".join(f"round(s_{r} / n, 12) AS m_{r}, s_{r} / n * (1 - s_{r} / n) AS e_{r}, CASE WHEN n - nn / n > 0 THEN greatest(0, round((q_{r} - n * (s_{r} / n) * (s_{r} / n) - (k - 1) * (s_{r} / n * (1 - s_{r} / n))) / (n - nn / n), 12)) ELSE 0 END AS v_{r}" for r in _RULES)
    + """ FROM sums),
fitted AS (SELECT """
    + ", ".join(f"m_{r}, CASE WHEN v_{r} > 0 THEN least(1e12, greatest(0, e_{r} / v_{r} - 1)) ELSE 1e12 END AS c_{r}" for r in _RULES)
    + """ FROM moments),
verdicts AS (SELECT source, source IS NOT NULL AND ("""
    + " OR ".join(_bad(r) for r in _RULES)
    + """) AS host_bad, round((f_short + m_short * c_short) / (n + c_short), 9) AS host_short_rate, round((f_repetitive + m_repetitive * c_repetitive) / (n + c_repetitive), 9) AS host_repetitive_rate FROM hosts, fitted)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT host_bad AS kept, host_bad, host_short_rate, host_repetitive_rate
FROM rows_ JOIN verdicts ON rows_.source IS NOT DISTINCT FROM verdicts.source
"""
)

#: h by a table of CRC-32; names of nodes are hashes of all that a path says.
TRIE_SQL = """
WITH table_ AS (SELECT list(r ORDER BY n) AS l FROM (SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS r FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n))),
t AS MATERIALIZED (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, role, text FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
c AS MATERIALIZED (SELECT conv_id, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda a, b: xor(a // 256, table_.l[xor(a, b) % 256 + 1])), 4294967295) % 6 AS h FROM (SELECT DISTINCT conv_id FROM t), table_),
re AS (SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = base AND pos <= h UNION ALL SELECT t.conv_id, pos, role, text FROM t JOIN c USING (conv_id) WHERE pos > h),
path AS MATERIALIZED (SELECT conv_id, 0 AS d, 'root' AS k, 0 AS chars FROM c UNION ALL
  SELECT conv_id, row_number() OVER w, md5(string_agg(length(role) || ':' || role || length(text) || ':' || text, '') OVER w), length(text) FROM re WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
node AS MATERIALIZED (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n, any_value(chars) AS chars FROM path GROUP BY ALL),
up AS MATERIALIZED (SELECT node.k, p.k AS parent, q.conv_id AS parent_conv_id FROM node JOIN path p ON p.conv_id = node.conv_id AND p.d = node.d - 1 JOIN node q ON q.k = p.k),
kids AS (SELECT parent AS k, count(*) AS n_children FROM up GROUP BY 1),
sub AS (SELECT p.k, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves, CAST(sum((node.n - 1) * node.chars) AS BIGINT) AS saved FROM node LEFT JOIN kids USING (k) JOIN path p ON p.conv_id = node.conv_id AND p.d <= node.d GROUP BY 1),
ends AS (SELECT k, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS h FROM (SELECT conv_id, max_by(k, d) AS k FROM path GROUP BY 1) GROUP BY 1)
SELECT node.conv_id, CAST(d AS BIGINT) AS depth, parent_conv_id, n AS n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved AS saved_tokens, coalesce(h, sha256('')) AS ends_sha256
FROM node LEFT JOIN up USING (k) LEFT JOIN kids USING (k) JOIN sub USING (k) LEFT JOIN ends USING (k)
"""
