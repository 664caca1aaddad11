"""DuckDB SQL of the operators that SQL can express."""

QUALITY_RULES_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS c FROM win) WHERE c > 1
), cover AS (
  SELECT doc_id, sum(step) AS n
  FROM (SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS step FROM rep) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
         len(lines)::BIGINT AS n_lines,
         length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS n_upper,
         length(t) - length(regexp_replace(t, '[\p{Lu}\p{Ll}]', '', 'g')) AS n_cased,
         len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_stutter,
         coalesce(list_max(list_transform(ws, lambda x: length(x))), 0) AS max_word
  FROM w LEFT JOIN cover ON w.doc_id = cover.doc_id
), f AS (
  SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END
    + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN n_cased >= 40 AND 100 * n_upper > 60 * n_cased THEN 16 ELSE 0 END
    + CASE WHEN n_words > 0 AND word_chars < 2 * n_words THEN 32 ELSE 0 END
    + CASE WHEN n_words > 0 AND word_chars > 15 * n_words THEN 64 ELSE 0 END
    + CASE WHEN max_word > 1000 THEN 128 ELSE 0 END
    + CASE WHEN 100 * n_stutter > 30 * n_words THEN 256 ELSE 0 END)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (failed & 3) <> 0 AS base_failed, (failed & 287) = 0 AS kept, failed
FROM f
"""

_BITS = ["few_words", "repeated_windows", "symbol_heavy", "repeated_lines", "shouting", "short_words", "long_words", "endless_word", "stutter"]
QUALITY_ABLATIONS_SQL = (
    QUALITY_RULES_SQL.rpartition("SELECT doc_id")[0]
    + ", r AS (SELECT unnest([" + ", ".join(f"'{n}'" for n in _BITS) + "]) AS rule, unnest(range(0, 9)) AS bit)\n"
    + "SELECT rule, count(*) FILTER ((failed & (1 << bit)) <> 0) AS n_failed, count(*) FILTER (failed = (1 << bit)) AS n_only, count(*) FILTER (failed = 0 OR failed = (1 << bit)) AS kept_without\n"
    + "FROM f, r GROUP BY rule"
)
