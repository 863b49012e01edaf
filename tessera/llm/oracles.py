"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from .quality import RULES, STOP_WORDS

WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = f"w AS (SELECT doc_id, text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS s FROM documents)"

OP1 = f"""WITH {WORDS},
g AS (SELECT doc_id, unnest(range(1, len(s) - 11)) AS i, unnest(list_transform(range(1, len(s) - 11), lambda i: md5(array_to_string(s[i:i+12], ' ')))) AS h FROM w WHERE len(s) >= 13),
m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS o FROM g),
c AS (SELECT DISTINCT doc_id, i + j AS k FROM m, range(13) t(j) WHERE o < doc_id),
x AS (SELECT doc_id, unnest(range(1, len(s) + 1)) AS k, unnest(s) AS t FROM w),
r AS (SELECT x.doc_id, count(c.k) AS n, string_agg(t, ' ' ORDER BY x.k) FILTER (c.k IS NULL) AS kept FROM x LEFT JOIN c ON x.doc_id = c.doc_id AND x.k = c.k GROUP BY 1)
SELECT w.doc_id, len(s)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r ON w.doc_id = r.doc_id"""


OP2 = f"""WITH {WORDS},
g AS (SELECT doc_id, unnest(range(1, len(s) - 43)) AS i, unnest(list_transform(range(1, len(s) - 43), lambda i: md5(array_to_string(s[i:i+44], ' ')))) AS h FROM w WHERE len(s) >= 45),
m AS (SELECT * FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS o FROM g) WHERE o < doc_id),
c AS (SELECT DISTINCT doc_id, i + j AS k FROM m, range(45) t(j)),
r AS (SELECT doc_id, min(k) AS i, count(*) AS n FROM (SELECT doc_id, k, k - row_number() OVER (PARTITION BY doc_id ORDER BY k) AS run FROM c) GROUP BY doc_id, run)
SELECT r.doc_id, (r.i - 1)::BIGINT AS start_word, r.n::BIGINT AS n_words, m.o AS first_doc_id FROM r JOIN m ON r.doc_id = m.doc_id AND r.i = m.i"""


def _op5() -> str:
    known = {
        "n_words": "n_words", "mean_word_chars": "word_chars / nullif(n_words, 0)", "symbol_ratio": "n_symbols / nullif(n_words, 0)", "stop_ratio": "n_stop / nullif(n_words, 0)",
        "dup_line_ratio": "n_dup_lines / nullif(n_lines, 0)", "repeat_ratio": "n_repeat_words / nullif(n_words, 0)",
    }
    tests = [f"coalesce({known[n]} {op} {b}, true)" for n, lo, hi in RULES for op, b in ((">=", lo), ("<=", hi)) if b is not None]
    stop = ", ".join(f"'{x}'" for x in STOP_WORDS)
    failed = "n_words < 50 OR 100 * n_repeat_words > 50 * n_words"
    return f"""WITH {WORDS},
g AS (SELECT doc_id, unnest(range(1, len(s) - 1)) AS i, unnest(list_transform(range(1, len(s) - 1), lambda i: s[i] || ' ' || s[i+1] || ' ' || s[i+2])) AS g FROM w WHERE len(s) >= 3),
d AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM d, range(3) t(j) GROUP BY 1),
l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM w),
b AS (SELECT w.doc_id, len(s)::BIGINT AS n_words, length(array_to_string(s, ''))::BIGINT AS word_chars, length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
 (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, len(ls) AS n_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(list_filter(s, lambda x: lower(x) IN ({stop}))) AS n_stop FROM w JOIN l USING (doc_id) LEFT JOIN r USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {failed} AS base_failed, NOT ({failed}) AND {' AND '.join(tests)} AS kept FROM b"""


OP7_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP7 = f"""WITH w AS (SELECT doc_id, {OP7_WORDS} AS s FROM documents), b AS (SELECT item_id, {OP7_WORDS} AS s FROM benchmark),
n AS (SELECT DISTINCT least(len(s), 8) AS n FROM b WHERE len(s) > 0),
bw AS (SELECT DISTINCT item_id, least(len(s), 8) AS n, array_to_string(s[i:i + least(len(s), 8) - 1], ' ') AS h FROM (SELECT item_id, s, unnest(range(1, greatest(len(s) - 7, 1) + 1)) AS i FROM b WHERE len(s) > 0)),
dw AS (SELECT doc_id, n, i, array_to_string(s[i:i + n - 1], ' ') AS h FROM (SELECT doc_id, s, n, unnest(range(1, len(s) - n + 2)) AS i FROM w, n WHERE len(s) >= n)),
m AS (SELECT doc_id, dw.n, i, item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.h = bw.h),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM m, range(8) t(j) WHERE j < n GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM m GROUP BY 1)
SELECT w.doc_id, len(s)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM w LEFT JOIN c ON w.doc_id = c.doc_id LEFT JOIN t ON w.doc_id = t.doc_id"""

STRIP = " || ".join(["' '", *(f"chr({i})" for i in range(9, 14))])
OP8 = f"""WITH l AS (SELECT doc_id, unnest(range(len(s))) AS i, unnest(s) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents)),
k AS (SELECT doc_id, i, line, translate(trim(line, {STRIP}), '{UPPER}', '{LOWER}') AS key FROM l),
o AS (SELECT doc_id, i, line, length(key) >= 10 AND min(doc_id) OVER (PARTITION BY key) < doc_id AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM o GROUP BY 1"""


OP10 = f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS s FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(s) - 3, 1) + 1), lambda i: array_to_string(s[i:i+3], ' '))) AS g FROM w WHERE len(s) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT a, y FROM r JOIN l ON b = x)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM r GROUP BY 1) ON a = w.doc_id"""


def oracle_sql() -> dict[str, str]:
    """Operators 3, 4, 6 and 9 have none; tests hold them against brute force, invariants or held-out accuracy."""
    return {"op1_substring_dedup": OP1, "op2_suffix_dedup": OP2, "op10_ngram_join": OP10, "op5_quality": _op5(), "op7_decontamination": OP7, "op8_line_dedup": OP8}
