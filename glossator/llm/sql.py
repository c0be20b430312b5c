"""DuckDB SQL for the corpus queries that SQL can express."""

from __future__ import annotations

from glossator.llm.secrets import BASE, MORE, Rule

LINE_DEDUP = """
WITH l AS (SELECT doc_id, ls, len(ls) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)),
w AS (SELECT doc_id, i - 1 AS pos, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS run FROM l, unnest(range(1, n - 1)) AS u(i)),
f AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS k FROM w),
g AS (SELECT DISTINCT doc_id, pos + j AS line FROM f, unnest([0, 1, 2]) AS u(j) WHERE k > 1),
r AS (SELECT l.doc_id, n, i - 1 AS line, ls[i] AS s, g.line IS NOT NULL AS gone FROM l CROSS JOIN unnest(range(1, n + 1)) AS u(i) LEFT JOIN g ON g.doc_id = l.doc_id AND g.line = i - 1)
SELECT doc_id, any_value(n)::INT AS n_lines, count(*) FILTER (gone)::INT AS n_removed, sha256(coalesce(string_agg(s, chr(10) ORDER BY line) FILTER (NOT gone), '')) AS kept_sha256 FROM r GROUP BY doc_id
"""

DECONTAMINATION = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM b, unnest(range(1, greatest(2, len(w) - 3))) AS u(p) WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, p, p + 4), ' ') AS s FROM d, unnest(range(1, len(w) - 3)) AS u(p)),
h AS (SELECT doc_id, item_id, count(*) AS f FROM s JOIN i USING (s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, f AS n_found, f / n AS containment FROM h JOIN n USING (item_id) WHERE f >= ceil(n * 0.8 - 1e-9)
"""

#: Base 32 takes five bits a letter: five hexadecimal digits are four letters.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS top FROM pages)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
 (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha1(h), 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1), '' ORDER BY i) FROM unnest(range(32)) AS u(i)) AS payload_digest,
 CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> top THEN top END AS refers_to FROM p
"""

#: The base patterns, written out apart from the operator's rules: pattern, group whose length counts, its least length.
SECRETS = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": ("AKIA[A-Z0-9]+", 0, 20),
    "hex": ("[0-9a-f]+", 0, 24),
}


def _spans(rule: Rule, number: int) -> str:
    """A kind's spans: texts between the matches and the matches themselves, their lengths added up."""
    regex, group, least = SECRETS.get(rule.kind, (rule.regex, rule.group, rule.least))
    regex = regex.replace("'", "''")
    return f"""s{number} AS (SELECT doc_id, list_filter(list_transform(range(1, len(m) + 1), lambda k: {{'start': (coalesce(list_sum(list_transform(p[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0))::INT, 'kind': {number}, 'size': length(m[k])::INT, 'g': length(g[k])}}), lambda y: y.g >= {least}) AS sp
FROM (SELECT doc_id, regexp_extract_all(t, '{regex}', 0) AS m, regexp_extract_all(t, '{regex}', {group}) AS g, regexp_split_to_array(t, '{regex}') AS p FROM t))"""


def secrets() -> str:
    rules = BASE + MORE
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in rules) + "]"
    shown = f"array_to_string(list_transform(list_sort({{x}}), lambda y: ({kinds})[y.kind + 1] || ':' || y.start || ':' || (y.start + y.size)), ',')"
    parts = ", ".join(_spans(r, i) for i, r in enumerate(rules))
    joins = " ".join(f"JOIN s{i} USING (doc_id)" for i in range(1, len(rules)))
    every = "list_concat(" + ", ".join(f"s{i}.sp" for i in range(len(rules))) + ")"
    base = "list_concat(s0.sp, s1.sp, s2.sp)"
    return f"WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), {parts} SELECT doc_id, len(s0.sp)::BIGINT AS n_assign, len(s1.sp)::BIGINT AS n_access, len(s2.sp)::BIGINT AS n_hex, sha256({shown.format(x=base)}) AS base_sha256, {shown.format(x=every)} AS spans FROM s0 {joins}"


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": LINE_DEDUP, "op2_decontamination": DECONTAMINATION, "op7_secrets": secrets(), "op11_warc": WARC}
