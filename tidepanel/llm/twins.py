"""SQL of the text queries, in DuckDB's dialect."""

from __future__ import annotations

from tidepanel.llm.licenses import templates

#: Words and rule outcomes of every document; ``{docs}`` names the table.
RULED = r"""
base AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM {docs}),
grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
again AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM grams) WHERE c > 1),
covered AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM again CROSS JOIN range(3) AS o(k) GROUP BY rid),
nonblank AS (
  SELECT rid, line FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
doubled AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS d FROM nonblank GROUP BY rid),
counted AS (
  SELECT b.rid, b.doc_id, b.source, b.t, CAST(len(b.w) AS BIGINT) AS n_words,
         CAST(length(b.t) - len(regexp_extract_all(b.t, '[\x20\x09-\x0D]')) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(b.t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         coalesce(d.n, 0) AS n_lines, CAST(coalesce(d.d, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words
  FROM base b LEFT JOIN covered c USING (rid) LEFT JOIN doubled d USING (rid)),
ruled AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats,
         100 * n_symbols > 50 * word_chars AS symbols, 100 * n_dup_lines > 50 * n_lines AS dup_lines
  FROM counted),
long_rules AS (
  UNPIVOT (SELECT source, CAST(short AS INT) AS short, CAST(repeats AS INT) AS repeats, CAST(symbols AS INT) AS symbols, CAST(dup_lines AS INT) AS dup_lines
           FROM ruled WHERE source IS NOT NULL) ON short, repeats, symbols, dup_lines INTO NAME rule VALUE failed),
hosts AS (SELECT source, rule, count(*) AS n, sum(failed) AS f FROM long_rules GROUP BY source, rule),
means AS (SELECT rule, sum(n) AS all_n, count(*) AS k, sum(f) / sum(n) AS m FROM hosts GROUP BY rule),
spread AS (SELECT h.rule, sum(h.n * (h.f / h.n - m.m) ** 2) AS s FROM hosts h JOIN means m USING (rule) GROUP BY h.rule),
prior AS (
  SELECT rule, m, CASE WHEN v > 0 THEN greatest(1.0, least(CAST(all_n AS DOUBLE), m * (1 - m) / v - 1)) ELSE CAST(all_n AS DOUBLE) END AS strength
  FROM (SELECT means.*, (s - k * m * (1 - m)) / all_n AS v FROM means JOIN spread USING (rule))),
rates AS (
  SELECT source, max(rate) AS host_rate, bool_or(rate > greatest(0.5, m + 2 * sqrt(m * (1 - m) / (strength + 1)))) AS host_failed,
         max(rate) FILTER (rule = 'short') AS rate_short, max(rate) FILTER (rule = 'repeats') AS rate_repeats,
         max(rate) FILTER (rule = 'symbols') AS rate_symbols, max(rate) FILTER (rule = 'dup_lines') AS rate_dup_lines
  FROM (SELECT source, rule, m, strength, (f + m * strength) / (n + strength) AS rate FROM hosts JOIN prior USING (rule)) GROUP BY source),
judged AS (
  SELECT ruled.*, rates.* EXCLUDE (source), short OR repeats AS base_failed,
         NOT (short OR repeats) AND NOT coalesce(host_failed, false) AS kept
  FROM ruled LEFT JOIN rates USING (source))
"""

QUALITY = (
    "WITH" + RULED.replace("{docs}", "documents") + """
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, source,
       round(rate_short, 6) AS rate_short, round(rate_repeats, 6) AS rate_repeats, round(rate_symbols, 6) AS rate_symbols, round(rate_dup_lines, 6) AS rate_dup_lines
FROM judged
"""
)

#: Word n-gram sets of distinct texts, their links and components; ``{n}`` words, ``{percent}`` hundredths.
LINKED = r"""
shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
         ELSE list_distinct([array_to_string(w[i:i + {n} - 1], ' ') FOR i IN range(1, len(w) - {n} + 2)]) END AS s
  FROM (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM {docs})),
members AS (SELECT doc_id, unnest(s) AS g FROM shingled),
shared_grams AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM members a JOIN members b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (
  SELECT x, y FROM shared_grams JOIN shingled a ON a.doc_id = x JOIN shingled b ON b.doc_id = y
  WHERE 100 * o >= {percent} * (len(a.s) + len(b.s) - o)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x),
tops AS (SELECT x AS doc_id, min(y) AS top FROM reach GROUP BY x),
linked AS (
  SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(t.top, s.doc_id)) AS component_id,
         CAST((SELECT count(*) FROM both_ways b WHERE b.x = s.doc_id) AS BIGINT) AS n_links
  FROM shingled s LEFT JOIN tops t USING (doc_id))
"""


def linked(docs: str, n: int, percent: int) -> str:
    return LINKED.replace("{docs}", docs).replace("{n}", str(n)).replace("{percent}", str(percent))


#: Lines of every document, and what goes; a line within two byte edits starts with, ends with or holds a third of the other.
LINES = r"""
place AS (
  SELECT DISTINCT doc_id, u.n - 1 AS line, u.s AS s
  FROM (SELECT doc_id, unnest([{'n': i, 's': l[i]} FOR i IN range(1, len(l) + 1)]) AS u
        FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM {docs} WHERE doc_id IS NOT NULL))
  WHERE regexp_matches(u.s, '[^\x20\x09-\x0D]')),
firsts AS (SELECT s, min({'d': doc_id, 'l': line}) AS at, strlen(s) AS n, length(s) AS c FROM place GROUP BY s),
near AS (
  SELECT a.s AS x, b.s AS y, a.at AS at_x, b.at AS at_y
  FROM firsts a JOIN firsts b ON abs(a.n - b.n) <= 2 AND a.s <> b.s
  WHERE a.n >= 24 AND b.n >= 24
    AND (starts_with(b.s, left(a.s, a.c // 3)) OR ends_with(b.s, right(a.s, a.c // 3)) OR contains(b.s, substr(a.s, a.c // 3 + 1, a.c - 2 * (a.c // 3))))
    AND levenshtein(a.s, b.s) <= 2),
late AS (SELECT x AS s, bool_or(at_y < at_x) AS late, count(*) AS links FROM near GROUP BY x),
fate AS (
  SELECT p.doc_id, p.line, coalesce(links, 0) AS links,
         coalesce(late, FALSE) OR f.at <> {'d': p.doc_id, 'l': p.line} AS gone
  FROM place p JOIN firsts f USING (s) LEFT JOIN late USING (s)),
line_fate AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, CAST(sum(links) AS BIGINT) AS n_near,
         coalesce(string_agg(CAST(line AS VARCHAR), ',' ORDER BY line) FILTER (gone), '') AS dropped
  FROM fate GROUP BY doc_id)
"""

LINE_DEDUP = (
    "WITH" + LINES.replace("{docs}", "documents") + """
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped, coalesce(n_near, 0) AS n_near, coalesce(dropped, '') AS dropped
FROM documents d LEFT JOIN line_fate USING (doc_id)
"""
)

LICENSES = r"""
WITH template(number, label, phrase, words) AS (VALUES {templates}),
needed(number, key, t_at) AS (VALUES {needed}),
needs AS (SELECT number, count(DISTINCT key) AS n_keys FROM needed GROUP BY number),
worded AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
t_grams AS (
  SELECT number, label, phrase, len(words) - 2 AS t_n, i - 1 AS t_at, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT *, unnest(range(1, len(words) - 1)) AS i FROM template)),
d_grams AS (SELECT rid, i - 1 AS d_at, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM worded)),
hits AS (SELECT rid, number, label, phrase, t_n, t_at, d_at, d_at - t_at AS diagonal FROM d_grams JOIN t_grams USING (g)),
diagonals AS (SELECT DISTINCT rid, number, phrase, diagonal FROM hits),
numbered AS (
  SELECT *, sum(CASE WHEN phrase OR diagonal - before > 2 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY rid, number ORDER BY diagonal) AS span
  FROM (SELECT *, lag(diagonal) OVER (PARTITION BY rid, number ORDER BY diagonal) AS before FROM diagonals)),
in_spans AS (SELECT h.*, n.span FROM hits h JOIN numbered n ON n.rid = h.rid AND n.number = h.number AND n.diagonal = h.diagonal),
told AS (SELECT rid, number, span, count(DISTINCT key) AS n_told FROM in_spans JOIN needed USING (number, t_at) GROUP BY rid, number, span),
spans AS (
  SELECT rid, number, label, phrase, t_n, span, min(diagonal) AS start, min(d_at) AS first_at, max(d_at) + 3 AS stop_at, count(DISTINCT t_at) AS held
  FROM in_spans GROUP BY ALL),
good AS (
  SELECT s.*, held / t_n AS share FROM spans s LEFT JOIN told USING (rid, number, span) LEFT JOIN needs USING (number)
  WHERE CASE WHEN phrase THEN held = t_n ELSE held / t_n >= 0.6 AND held >= 6 AND n_told = n_keys END),
best AS (
  SELECT * FROM good a
  WHERE phrase OR NOT EXISTS (
    SELECT 1 FROM good b WHERE b.rid = a.rid AND NOT b.phrase AND b.label <> a.label AND b.first_at < a.stop_at AND a.first_at < b.stop_at
      AND (b.share > a.share OR (b.share = a.share AND (b.held > a.held OR (b.held = a.held AND b.number < a.number)))))),
found AS (
  SELECT rid, count(*) FILTER (phrase) AS n_base, min(start) FILTER (phrase) AS first_word, max(start) FILTER (phrase) AS last_word,
         coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase), '') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM best GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM worded LEFT JOIN found USING (rid)
""".replace("{templates}", ", ".join(f"({i}, '{label}', {phrase}, {text.split()})" for i, label, phrase, text, _ in templates())).replace(
    "{needed}", ", ".join(f"({i}, {k}, {t})" for i, _, _, _, needed in templates() for k, places in enumerate(needed) for t in places)
)

LEAKS = r"""
WITH cut AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
window_of AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM window_of),
place AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM cut CROSS JOIN sizes)),
held AS (SELECT DISTINCT rid, i, n, g FROM place SEMI JOIN window_of USING (n, g)),
words AS (SELECT rid, count(DISTINCT word) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS word FROM held) GROUP BY rid),
pairs AS (SELECT DISTINCT rid, item FROM held JOIN window_of USING (n, g)),
listed AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM pairs GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM cut LEFT JOIN words USING (rid) LEFT JOIN listed USING (rid)
"""

ORACLES = {
    "op13_decontamination": LEAKS,
    "op9_license_scan": LICENSES,
    "op7_line_dedup": LINE_DEDUP,
    "op1_quality_rules": QUALITY,
    "op4_ngram_join": "WITH RECURSIVE" + linked("documents", 3, 90) + "SELECT doc_id, n_shingles, component_id, n_links FROM linked",
}
