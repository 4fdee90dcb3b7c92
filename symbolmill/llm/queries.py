"""Registered queries of the text operators (problems 4 to 9) and, where SQL can say them, their SQL."""

from __future__ import annotations

from symbolmill.catalog import read, read_spread
from symbolmill.llm.docpairs import documented_functions, documented_symbols
from symbolmill.llm.foreign import file_features, foreign_files
from symbolmill.llm.packing import fill_containers, fill_report
from symbolmill.llm.spans import SharedSpans
from symbolmill.llm.syntax import invalid_files, invalid_rates
from symbolmill.llm.tokens import count_tokens, encode_documents


def p4_found(spark, d):
    return p4_pairs(spark, d).select("symbol_id").distinct()


def p4_pairs(spark, d):
    return documented_symbols(read(spark, d, "symbols"), read_spread(spark, d, "files"))


def p4_functions(spark, d):
    return documented_functions(read_spread(spark, d, "files")).distinct()


def p5_found(spark, d):
    return foreign_files(read_spread(spark, d, "files"), read(spark, d, "external_symbols")).select("file_id")


def p5_reasons(spark, d):
    return foreign_files(read_spread(spark, d, "files"), read(spark, d, "external_symbols"))


def p5_layout(spark, d):
    cols = ("file_id", "language", "n_chars", "n_lines", "max_line")
    return file_features(read_spread(spark, d, "files")).select(*cols).distinct()


def p6_found(spark, d):
    return invalid_files(read_spread(spark, d, "files")).select("file_id")


def p6_rates(spark, d):
    return invalid_rates(read_spread(spark, d, "files"))


def p7_ids(spark, d):
    return encode_documents(read(spark, d, "documents"))


def p7_counts(spark, d):
    return count_tokens(read(spark, d, "documents"))


def p8_containers(spark, d):
    return fill_containers(read(spark, d, "documents"), read(spark, d, "container_sizes"))


def p8_report(spark, d):
    return fill_report(p8_containers(spark, d))


def p9_found(spark, d):
    return SharedSpans(read_spread(spark, d, "documents")).pairs()


def p9_shares(spark, d):
    return SharedSpans(read_spread(spark, d, "documents")).shares()


def p9_passages(spark, d):
    return SharedSpans(read_spread(spark, d, "documents"), beyond=1).passages()


_ALL = (
    p4_found, p4_pairs, p4_functions, p5_found, p5_reasons, p5_layout, p6_found, p6_rates,
    p7_ids, p7_counts, p8_containers, p8_report, p9_found, p9_shares, p9_passages,
)
QUERIES = {f.__name__: f for f in _ALL}

#: All spans of 200 characters that stand in more than one document.
_GRAMS = """
WITH g AS (SELECT doc_id, text, unnest(range(1, length(text) - 198)) AS i FROM documents WHERE length(text) >= 200),
h AS (SELECT doc_id, i, substring(text, i, 200) AS s FROM g),
m AS (SELECT s FROM h GROUP BY s HAVING min(doc_id) < max(doc_id)),
shared AS (SELECT h.doc_id, h.i, h.s FROM h JOIN m USING (s))
"""

SQL = {
    "p5_layout": r"""
WITH l AS (
  SELECT DISTINCT file_id, language, coalesce(content, '') AS content,
    list_filter(regexp_split_to_array(coalesce(content, ''), '\r\n|\r|\n'), lambda x: regexp_matches(x, '\S')) AS lines FROM files)
SELECT file_id, language, CAST(length(content) AS BIGINT) AS n_chars, CAST(len(lines) AS BIGINT) AS n_lines,
  CAST(coalesce(list_max(list_transform(lines, lambda x: length(x))), 0) AS BIGINT) AS max_line
FROM l""",
    "p9_found": _GRAMS
    + """SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM shared a JOIN shared b ON a.s = b.s AND a.doc_id < b.doc_id""",
    "p9_shares": _GRAMS
    + """, c AS (SELECT doc_id, CAST(sum(least(200, n - i)) AS BIGINT) AS c FROM (
  SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 200) AS n FROM (SELECT DISTINCT doc_id, i FROM shared)) GROUP BY 1)
SELECT d.doc_id, d.n AS n_chars, coalesce(c.c, 0) AS shared_chars, CASE WHEN d.n > 0 THEN round(coalesce(c.c, 0) / d.n, 6) ELSE 0.0 END AS shared_share
FROM (SELECT doc_id, CAST(length(coalesce(text, '')) AS BIGINT) AS n FROM documents) d LEFT JOIN c USING (doc_id)""",
    "p9_passages": _GRAMS
    + """, n AS (SELECT s, count(DISTINCT doc_id) AS n FROM shared GROUP BY s),
w AS (SELECT shared.doc_id, shared.i, n.n FROM shared JOIN n USING (s)), u AS (SELECT doc_id, i, max(n) AS n FROM w GROUP BY ALL),
longer AS (SELECT doc_id, i, substring(text, i, 201) AS t FROM g WHERE i + 200 <= length(text)), ln AS (SELECT t, count(DISTINCT doc_id) AS n FROM longer GROUP BY t),
pairs AS (SELECT longer.doc_id, longer.i, ln.n FROM longer JOIN ln USING (t)), together AS (SELECT doc_id, i, max(n) AS n FROM pairs GROUP BY ALL),
b AS (SELECT u.doc_id, u.i, CASE WHEN p.i IS NULL OR t.n < u.n OR t.n < p.n THEN 1 ELSE 0 END AS fresh
  FROM u LEFT JOIN u p ON p.doc_id = u.doc_id AND p.i = u.i - 1 LEFT JOIN together t ON t.doc_id = u.doc_id AND t.i = u.i - 1),
k AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM b), r AS (SELECT doc_id, min(i) AS s, max(i) AS e FROM k GROUP BY doc_id, k)
SELECT DISTINCT sha256(substring(text, s, e - s + 200)) AS passage_id, r.doc_id, CAST(s - 1 AS INTEGER) AS span_start, CAST(e + 199 AS INTEGER) AS span_end FROM r JOIN documents USING (doc_id)""",
}
