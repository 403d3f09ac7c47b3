"""DuckDB SQL for the training-data queries that SQL can express."""

from __future__ import annotations

#: ``crc``: the remainders of all bytes, in one row; ``_crc32`` reads them.
CRC_TABLE = """crc AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_concat([CAST(i AS UBIGINT)], CAST(range(8) AS UBIGINT[])),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(CAST(3988292384 AS UBIGINT), c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(i)))"""


def _crc32(text: str) -> str:
    """The unsigned CRC-32 of a text of letters up to U+00FF in UTF-8; the statement must join ``crc``."""
    letters = f"list_transform(string_split({text}, ''), lambda x: CAST(unicode(x) AS UBIGINT))"
    octets = f"flatten(list_transform({letters}, lambda p: CASE WHEN p < 128 THEN [p] ELSE [194 + p // 192, 128 + p % 64] END))"
    first = "[CAST(4294967295 AS UBIGINT)]"
    return f"xor(list_reduce(list_concat({first}, CAST({octets} AS UBIGINT[])), lambda c, b: xor(t[CAST(xor(c % 256, b) AS INTEGER) + 1], c >> 8)), CAST(4294967295 AS UBIGINT))"


EXACT_GROUPS = """SELECT doc_id, MAX(doc_id) OVER g AS keep_id, COUNT(*) OVER g AS group_size, doc_id = MAX(doc_id) OVER g AS kept, sha256(body) AS text_sha256
 FROM (SELECT doc_id, COALESCE(text, '') AS body FROM documents) WINDOW g AS (PARTITION BY body)"""

PREFIXES = f"""WITH {CRC_TABLE},
own AS (SELECT conv_id, list(struct_pack(r := COALESCE(role, ''), x := COALESCE(text, '')) ORDER BY turn NULLS FIRST) AS turns FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
heads AS (SELECT conv_id, CAST({_crc32("CAST(conv_id AS VARCHAR)")} % 4 AS BIGINT) AS h, turns FROM own CROSS JOIN crc),
rebuilt AS (SELECT a.conv_id, list_concat(COALESCE(b.turns[1:a.h], []), a.turns[a.h + 1:]) AS turns FROM heads a LEFT JOIN own b ON b.conv_id = a.conv_id - a.conv_id % 20),
met AS (SELECT conv_id, len(turns) AS size, d, turns[1:d] AS path FROM rebuilt, unnest(range(len(turns) + 1)) r(d)),
nodes AS (SELECT path, d, MIN(conv_id) AS conv_id, COUNT(*) AS n_convs, sha256(COALESCE(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256,
 (COUNT(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(path[d].x, '[^\\x20\\x09-\\x0D]+')) END AS saved FROM met GROUP BY path, d),
kids AS (SELECT path[1:d - 1] AS path, COUNT(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
counted AS (SELECT nodes.*, COALESCE(kids.n, 0) AS n_children FROM nodes LEFT JOIN kids USING (path)),
sums AS (SELECT path[1:a] AS path, COUNT(*) FILTER (n_children = 0) AS n_leaves, CAST(SUM(saved) AS BIGINT) AS saved_tokens FROM counted, unnest(range(d + 1)) r(a) GROUP BY 1)
SELECT c.conv_id, c.d AS depth, p.conv_id AS parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
 FROM counted c JOIN sums USING (path) LEFT JOIN nodes p ON c.d > 0 AND p.d = c.d - 1 AND p.path = c.path[1:c.d - 1]"""

SPELLING = f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT id, run, COUNT(*) AS times FROM (SELECT COALESCE(CAST(doc_id AS VARCHAR), '') AS id,
  translate(unnest(regexp_extract_all(COALESCE(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents) WHERE length(run) >= 7 GROUP BY 1, 2),
hashed AS (SELECT run, times, CAST({_crc32("id || ':' || run")} AS BIGINT) AS h FROM runs CROSS JOIN crc),
spelt AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, times FROM hashed),
words AS MATERIALIZED (SELECT word, CAST(SUM(times) AS BIGINT) AS n FROM spelt WHERE length(word) >= 7 GROUP BY 1 HAVING SUM(times) >= 2),
holes AS MATERIALIZED (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS hole, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM words, unnest(range(1, length(word) + 1)) r(i)),
shorter AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM holes a JOIN words b ON a.less = b.word),
pairs AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM holes a JOIN holes b ON a.hole = b.hole AND a.word <> b.word
 UNION ALL SELECT word, n, near, near_n FROM shorter UNION ALL SELECT near, near_n, word, n FROM shorter),
best AS (SELECT word, COUNT(*) AS n_near, arg_min(struct_pack(w := near, c := near_n), struct_pack(a := -near_n, b := near)) AS top FROM pairs GROUP BY word),
forms AS MATERIALIZED (SELECT word, n, COALESCE(n_near, 0) AS n_near, CASE WHEN top.c >= 10 * n THEN top.w END AS form, CASE WHEN top.c >= 10 * n THEN top.c END AS form_n FROM words LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, form AS next FROM forms UNION ALL SELECT walk.word, forms.word, forms.form FROM walk JOIN forms ON walk.next = forms.word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, root FROM walk WHERE next IS NULL) USING (word)"""
