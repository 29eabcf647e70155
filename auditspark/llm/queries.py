"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .codes import op11_vector_codes
from .fingerprints import op2_scaled_sketch
from .decontamination import op6_decontamination
from .hosts import op13_host_rules
from .language import op1_language_id
from .packing import op9_curve_packing
from .phrases import op3_phrase_automata
from .prefixes import op12_prefix_trie
from .secrets import op4_markov_secrets
from .sharding import op7_jump_sharding
from .simhash import op10_simhash_bktree
from .sql import CODES_SQL, HOSTS_SQL, TRIE_SQL
from .suffixes import op8_induced_suffixes
from .toxicity import op5_toxicity

QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_scaled_sketch": op2_scaled_sketch,
    "op3_phrase_automata": op3_phrase_automata,
    "op4_markov_secrets": op4_markov_secrets,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_jump_sharding": op7_jump_sharding,
    "op8_induced_suffixes": op8_induced_suffixes,
    "op9_curve_packing": op9_curve_packing,
    "op10_simhash_bktree": op10_simhash_bktree,
    "op11_vector_codes": op11_vector_codes,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_host_rules": op13_host_rules,
}

#: The jumps of each key in order; a shard is the last one below the shard count.
JUMP_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, coalesce(text, '') AS t,
         ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 16))::UBIGINT::HUGEINT AS k0
  FROM documents),
steps AS (
  SELECT doc_id, k0 AS k, CAST(0 AS BIGINT) AS j FROM d
  UNION ALL
  SELECT doc_id, (k * 2862933555777941757 + 1) % 18446744073709551616,
         CAST(floor((j + 1) * (2147483648.0::DOUBLE / (((k * 2862933555777941757 + 1) % 18446744073709551616 // 8589934592)::DOUBLE + 1.0::DOUBLE))) AS BIGINT)
  FROM steps WHERE j < 9),
s AS (SELECT doc_id, max(j) FILTER (WHERE j < 8) AS shard, max(j) FILTER (WHERE j < 9) AS grown_shard FROM steps GROUP BY 1),
table_ AS (SELECT list(r ORDER BY n) AS l FROM (SELECT n, list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS r FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS n))),
digits AS (SELECT list_transform(range(256), lambda n: upper(lpad(to_hex(n), 2, '0'))) AS l),
c AS (SELECT doc_id, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: CAST(list_position(digits.l, x) - 1 AS BIGINT))),
    lambda a, b: xor(a // 256, table_.l[xor(a, b) % 256 + 1])), 4294967295) AS text_crc32 FROM d, table_, digits)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY substr(md5(CAST(doc_id AS VARCHAR)), 17, 3), doc_id, size, text_crc32) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM d JOIN s USING (doc_id) JOIN c USING (doc_id)
"""

#: Every row counts by itself, so rows are numbered.
PHRASES_SQL = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS l FROM documents),
win AS (SELECT r, i, md5(array_to_string(l[i:i + 34], ' ')) AS h FROM (SELECT r, l, unnest(range(1, len(l) - 33)) AS i FROM w WHERE len(l) >= 35)),
again AS (SELECT r, i FROM win WHERE h IN (SELECT h FROM win GROUP BY h HAVING count(*) > 1)),
gone AS (SELECT DISTINCT r, i + d AS i FROM again, (SELECT unnest(range(35)) AS d)),
each AS (SELECT r, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS word FROM w),
kept AS (SELECT e.r, string_agg(e.word, ' ' ORDER BY e.i) FILTER (WHERE g.i IS NULL) AS t, count(g.i) AS n FROM each e LEFT JOIN gone g USING (r, i) GROUP BY 1)
SELECT w.doc_id, CAST(len(l) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r)
"""

#: Rows with one id and text are one document (d); others with one id come by the MD5 of their text.
BYTES_SQL = """
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST, md5(t)) AS d, doc_id, t FROM (SELECT DISTINCT doc_id, coalesce(text, '') AS t FROM documents)),
b AS (SELECT d, doc_id, hex(encode(t)) AS h, strlen(t) AS n FROM d),
win AS (SELECT d, p, md5(substr(h, 2 * p + 1, 200)) AS m FROM (SELECT d, h, unnest(range(0, n - 99)) AS p FROM b WHERE n >= 100)),
late AS (SELECT d, p FROM (SELECT d, p, row_number() OVER (PARTITION BY m ORDER BY d, p) AS r FROM win) WHERE r > 1),
edge AS (SELECT d, p, coalesce(p - lag(p) OVER (PARTITION BY d ORDER BY p), 1000) > 100 AS new FROM late),
run AS (SELECT d, min(p) AS s, max(p) + 100 AS e FROM (SELECT *, sum(CASE WHEN new THEN 1 ELSE 0 END) OVER (PARTITION BY d ORDER BY p) AS k FROM edge) GROUP BY d, k),
cut AS (SELECT d, sum(e - s) AS n_removed, count(*) AS n_spans FROM run GROUP BY 1),
part AS (SELECT b.d, s, substr(h, 2 * coalesce(lag(e) OVER w, 0) + 1, 2 * (s - coalesce(lag(e) OVER w, 0))) AS t FROM b JOIN run USING (d) WINDOW w AS (PARTITION BY b.d ORDER BY s)),
kept AS (SELECT b.d, string_agg(part.t, '' ORDER BY part.s) || any_value(substr(h, 2 * x.e + 1)) AS t FROM b JOIN part USING (d) JOIN (SELECT d, max(e) AS e FROM run GROUP BY 1) x USING (d) GROUP BY 1),
found AS (SELECT b.doc_id, d.t, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept.t, h))) AS kept_sha256
FROM b JOIN d USING (d) LEFT JOIN cut USING (d) LEFT JOIN kept USING (d))
SELECT x.doc_id, n_bytes, n_removed, n_spans, kept_sha256 FROM documents x JOIN found f ON x.doc_id IS NOT DISTINCT FROM f.doc_id AND coalesce(x.text, '') = f.t
"""

ORACLE_SQL: dict[str, str] = {
    "op3_phrase_automata": PHRASES_SQL,
    "op7_jump_sharding": JUMP_SQL,
    "op8_induced_suffixes": BYTES_SQL,
    "op11_vector_codes": CODES_SQL,
    "op12_prefix_trie": TRIE_SQL,
    "op13_host_rules": HOSTS_SQL,
}
