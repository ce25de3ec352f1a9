"""DuckDB SQL of the operators that SQL can express on whole tables."""

from __future__ import annotations

from .quality import BOILERPLATE, CLOSERS, ENDS, MENU

_WORD = r"[^\x20\x09-\x0D]+"
_SPACE = r"[\x20\x09-\x0D]"

OP1 = """
WITH src AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i - 1 AS line_no, string_split(trim(ls[i], ' '), ' ') AS w FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM src)),
k AS (SELECT doc_id * 1000000 + line_no AS ord, doc_id, line_no, w, len(w) AS n, array_to_string(w, ' ') AS t FROM l WHERE len(w) >= 5 OR regexp_matches(array_to_string(w, ' '), '[^\\s\\p{Z}\\p{Cc}\\p{Cf}]')),
u AS (SELECT t, min(ord) AS ord, any_value(w) AS w, any_value(n) AS n FROM k GROUP BY t),
r AS (SELECT ord, md5(n || '|' || i || '|' || array_to_string(w[1:i - 1], ' ') || '|' || array_to_string(w[i + 1:n], ' ')) AS key FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM u WHERE n >= 10)),
d AS (SELECT ord, md5(array_to_string(list_concat(w[1:i - 1], w[i + 1:n]), ' ')) AS key FROM (SELECT *, unnest(range(1, n + 1)) AS i FROM u WHERE n >= 11)),
f AS (SELECT ord, md5(t) AS key FROM u WHERE n >= 10),
near AS (SELECT ord FROM r JOIN (SELECT key, min(ord) AS m FROM r GROUP BY key) USING (key) WHERE m < ord
 UNION SELECT d.ord FROM d JOIN f USING (key) WHERE f.ord < d.ord UNION SELECT f.ord FROM f JOIN d USING (key) WHERE d.ord < f.ord),
gone AS (SELECT k.doc_id, k.line_no FROM k JOIN u USING (t) WHERE k.ord <> u.ord OR u.ord IN (SELECT ord FROM near)),
g AS (SELECT doc_id, list(line_no) AS rm FROM gone GROUP BY doc_id)
SELECT doc_id, len(ls) AS n_lines, coalesce(len(rm), 0) AS n_removed, sha256(array_to_string(list_filter(ls, lambda x, i: NOT list_contains(coalesce(rm, []), i - 1)), chr(10))) AS kept_sha256
FROM src LEFT JOIN g USING (doc_id)
"""

_BOILER = "|".join(BOILERPLATE).replace("'", "''")
_CLOSE = CLOSERS.replace("'", "''").replace("]", "\\]")
_MENU = "|".join(MENU)
OP4 = rf"""
WITH src AS (SELECT doc_id, text, regexp_extract_all(text, '{_WORD}') AS w, string_split(text, chr(10)) AS ls FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 7], ' ')) AS key FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM src)),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM win WHERE (doc_id, key) IN (SELECT (doc_id, key) FROM win GROUP BY doc_id, key HAVING count(*) > 1)) GROUP BY doc_id),
l AS (SELECT doc_id, i, ls[i] AS line, regexp_replace(ls[i], '{_SPACE}', '', 'g') AS dense, regexp_extract_all(ls[i], '{_WORD}') AS w FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM src)),
j AS (SELECT *, 100 * (strlen(dense) - strlen(regexp_replace(dense, '[#*$%&|<>!?~^=_{{}}\[\]\\]', '', 'g'))) > 10 * strlen(dense)
 OR (len(w) >= 5 AND NOT regexp_matches(line, '[{ENDS}][{_CLOSE}]*{_SPACE}*$')) OR (regexp_matches(lower(line), ' (\||»|›|::|•) ') AND len(w) <= 12)
 OR 100 * len(list_filter(range(1, len(w)), lambda k: w[k] = w[k + 1])) > 30 * len(w) OR 100 * len(list_filter(w, lambda x: regexp_full_match(x, '[!-/:-@\[-`{{-~]+'))) > 25 * len(w)
 OR regexp_full_match(regexp_replace(lower(line), '^{_SPACE}+|{_SPACE}+$', '', 'g'), '({_MENU})') OR regexp_matches(lower(line), '{_BOILER}') AS fails,
 row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM l WHERE dense <> ''),
per AS (SELECT doc_id, count(*) FILTER (WHERE again) AS dups, coalesce(sum(len(dense)) FILTER (WHERE fails), 0) AS lost FROM j GROUP BY doc_id),
c AS (SELECT s.doc_id, len(w) AS n_words, len(regexp_replace(text, '{_SPACE}', '', 'g')) AS word_chars, len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dups, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost
 FROM src s LEFT JOIN per USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * lost <= 50 * word_chars AS kept FROM c
"""

_LOWER = "translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_MARKS = r"!-/:-@\[-`{-~"


def _grams(table: str, key: str, n: int, words: str) -> str:
    return f"SELECT DISTINCT {key}, md5(array_to_string(w[i:i + {n - 1}], ' ')) AS g FROM (SELECT {key}, w, unnest(range(1, greatest(len(w) - {n - 2}, 2))) AS i FROM (SELECT {key}, {words} AS w FROM {table}) WHERE len(w) > 0)"


_BARE = f"list_filter(list_transform(regexp_extract_all({_LOWER.format(x='text')}, '{_WORD}'), lambda x: regexp_replace(x, '^[{_MARKS}]+|[{_MARKS}]+$', '', 'g')), lambda x: x <> '')"
OP6 = f"""
WITH d AS ({_grams("documents", "doc_id", 5, _BARE)}), b AS ({_grams("benchmark", "item_id", 5, _BARE)}),
q AS (SELECT item_id, count(*) AS q FROM b GROUP BY item_id),
hit AS (SELECT doc_id, item_id FROM d JOIN b USING (g) JOIN q USING (item_id) GROUP BY doc_id, item_id, q HAVING 100 * count(*) >= 80 * q),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id), h AS (SELECT doc_id, count(*) AS c, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, 0) AS n_items, coalesce(ids, '') AS item_ids, coalesce(c, 0) > 0 AS contaminated FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN h USING (doc_id)
"""

_LOW = f"regexp_extract_all({_LOWER.format(x='text')}, '{_WORD}')"
OP9 = f"""
WITH RECURSIVE s AS MATERIALIZED ({_grams("documents", "doc_id", 4, _LOW)}), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id) p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
edges AS MATERIALIZED (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS node, b AS hop FROM edges UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.hop)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id, d.doc_id = least(d.doc_id, coalesce(m.m, d.doc_id)) AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT node AS doc_id, min(hop) AS m FROM reach GROUP BY node) m USING (doc_id)
"""

ORACLE_SQL = {"op1_line_dedup": OP1, "op4_quality": OP4, "op6_decontamination": OP6, "op9_near_duplicates": OP9}
