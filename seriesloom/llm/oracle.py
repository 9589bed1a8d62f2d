"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

OP2 = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents
), parts AS (
  SELECT doc_id, t,
    list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^ \t\n\x0B\f\r]')) AS lines
  FROM base
), spread AS (
  SELECT doc_id, unnest(range(1, len(words) - 3)) AS i, words FROM parts WHERE len(words) >= 5
), windows AS (
  SELECT doc_id, i, words[i : i + 4] AS w FROM spread
), twice AS (
  SELECT doc_id, i FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id
), measured AS (
  SELECT p.doc_id,
    len(words)::BIGINT AS n_words,
    coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    len(lines)::BIGINT AS n_lines,
    len(list_filter(words, lambda w: list_contains(string_split('{stop}', ' '), lower(w))))::BIGINT
      AS n_stop_words,
    len(list_filter(words, lambda w: regexp_matches(w, '\p{{Lu}}{{2}}') AND NOT
      regexp_matches(w, '\p{{Ll}}')))::BIGINT AS n_upper_words
  FROM parts p LEFT JOIN covered c USING (doc_id)
), judged AS (
  SELECT *, n_words < 10 OR n_repeat_words * 100 > n_words * 20 AS base_failed FROM measured
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars * 100 BETWEEN n_words * 200 AND n_words * 1500
    AND n_symbols * 100 <= n_words * 10 AND n_stop_words * 100 >= n_words * 2
    AND n_dup_lines * 100 <= n_lines * 30 AND n_upper_words * 100 <= n_words * 50 AS kept,
  n_lines, n_stop_words, n_upper_words
FROM judged
"""

# Frequent short words of English, German, French and Spanish.
OP2_STOP = (
    "the of and to in is it that for was on are as with by be this have from or at "
    "der die das und ist von mit den zu nicht sich auf für im ein eine als auch dem des "
    "le la les et des un une du que est pour dans qui sur pas par plus avec ce il "
    "el los las y del por con para una como más lo su al es en de se"
)

OP9 = """
WITH sized AS (
  SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes,
    sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), owned AS (
  SELECT *, CASE WHEN payload_bytes >= 1000
    THEN max(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS owner
  FROM sized
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM owned
"""

OP12 = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
    sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), numbered AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units,
    ('0x' || substr(h, 1, 8))::UBIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT AS h2,
    ('0x' || substr(h, 17, 8))::UBIGINT AS h3, ('0x' || substr(h, 25, 8))::UBIGINT AS h4
  FROM base
), chosen AS (
  SELECT *, len(units) AS n,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
      OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM numbered
), cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1))::BIGINT AS lo,
    greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT AS hi
  FROM chosen
), parts AS (
  SELECT *, array_to_string(list_slice(units, 1, lo), '') AS prefix,
    array_to_string(list_slice(units, lo + 1, hi), '') AS middle,
    array_to_string(list_slice(units, hi + 1, n), '') AS suffix
  FROM cut
)
SELECT doc_id, n::BIGINT AS n, form,
  CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t
    WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""

ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": OP2.replace("{stop}", OP2_STOP).replace("{{", "{").replace("}}", "}"),
    "op9_warc": OP9,
    "op12_fill_in_middle": OP12,
}
