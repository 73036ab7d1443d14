"""Registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kassa.llm.codebooks import op11_vector_codes
from kassa.llm.decontaminate import op3_decontaminate
from kassa.llm.jaccard import op7_jaccard_join
from kassa.llm.langid import op9_language_id
from kassa.llm.licenses import op4_license_scan
from kassa.llm.pieces import op2_sentencepiece
from kassa.llm.quality import op10_quality_rules
from kassa.llm.repeats import op6_substring_dedup
from kassa.llm.shards import op12_sharding
from kassa.llm.sql import OP11_SQL, OP12_SQL, OP13_SQL
from kassa.llm.surrogates import op8_pii_surrogates
from kassa.llm.token_files import op5_token_files
from kassa.llm.trie import op13_prefix_trie
from kassa.llm.warc import op1_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_decontaminate": op3_decontaminate,
    "op4_license_scan": op4_license_scan,
    "op5_token_files": op5_token_files,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_jaccard_join": op7_jaccard_join,
    "op8_pii_surrogates": op8_pii_surrogates,
    "op9_language_id": op9_language_id,
    "op10_quality_rules": op10_quality_rules,
    "op11_vector_codes": op11_vector_codes,
    "op12_sharding": op12_sharding,
    "op13_prefix_trie": op13_prefix_trie,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all({_LOWER}, '{_ALNUM}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 13) AS n,
         array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS win
       FROM (SELECT item, w, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i
             FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
             FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw USING (n, win)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
ids AS (SELECT doc_id, count(DISTINCT item) AS n_items,
          coalesce(string_agg(DISTINCT item, ',' ORDER BY item), '') AS s FROM m GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

_B32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(sha, {5 * g + 1}, 5))::INT >> {s} & 31) + 1, 1)"
    for g in range(8) for s in (15, 10, 5, 0))

OP1_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS sha
           FROM pages),
g AS (SELECT sha, max(page_id) AS top FROM p GROUP BY sha)
SELECT page_id, payload_bytes, {_B32} AS payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM p JOIN g USING (sha)
"""

_SPACE = r"[^\x20\x09-\x0D]+"

OP7_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_SPACE}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o
      FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM o JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
      WHERE 100 * o >= 75 * (a.n + b.n - o)),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents
      UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(y) AS c FROM r GROUP BY x) m ON m.x = d.doc_id
"""

OP6_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACE}') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 34), ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT g FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM win JOIN twice USING (g)),
words AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, count(gone.p) AS n_removed,
           coalesce(string_agg(x, ' ' ORDER BY p) FILTER (gone.p IS NULL), '') AS t
         FROM words LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_warc": OP1_SQL,
    "op3_decontaminate": OP3_SQL,
    "op6_substring_dedup": OP6_SQL,
    "op7_jaccard_join": OP7_SQL,
    "op11_vector_codes": OP11_SQL,
    "op12_sharding": OP12_SQL,
    "op13_prefix_trie": OP13_SQL,
}
