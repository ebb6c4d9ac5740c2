"""DuckDB SQL for the operators that SQL can express, written apart from their DataFrame forms."""

from __future__ import annotations

from .op4_mixing import BUDGET, EPOCHS, LEVELS, SEED, WEIGHTS
from .op8_licenses import LEAST, NEIGHBOURS, PHRASES, TEMPLATES, VERIFY, K


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _secrets() -> str:
    names = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either_case("api") + "_?" + _either_case("key")
    assign = rf"({names})[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
    provider = r"(?:gh[opsu]_[A-Za-z0-9]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[A-Za-z0-9]{10,}|AIza[A-Za-z0-9_-]{30,}|eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,})"
    patterns = {"assign": assign, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}", "provider": provider}
    words = "example changeme change dummy sample placeholder password passwd secret token value string default insert replace redacted undefined hidden access api key your my test here null none true false todo"
    same = "|".join(("\\" + c if c in "+/_.=-" else c) + "{4,}" for c in "abcdefghijklmnopqrstuvwxyz0123456789+/_.=-")  # RE2 knows no way back
    filler = "|".join(words.split()) + f"|deadbeef|qwerty|0123456789abcdef|0?1234(?:5(?:6(?:7(?:8(?:90?)?)?)?)?)?|123|abcdef|abcd|{same}|[+/_.=-]"
    found = " UNION ALL ".join(f"SELECT rid, '{k}' AS kind, {i} AS rank, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS g FROM t" for i, (k, p) in enumerate(patterns.items()))
    shown = "kind || ':' || start || ':' || stop, ',' ORDER BY start, rank"
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS text FROM documents), x AS ({found}),
s AS (SELECT rid, kind, rank, m, g, unnest(range(1, len(m) + 1)) AS i FROM x),
p AS (SELECT rid, kind, rank, m[i] AS match, list_sum(list_transform(g[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda y: length(y))), 0) AS start,
  CASE WHEN kind = 'assign' THEN regexp_extract(m[i], '{assign}', 2) ELSE m[i] END AS value FROM s),
c AS (SELECT rid, kind, rank, value, CAST(start AS BIGINT) AS start, CAST(start + length(match) AS BIGINT) AS stop FROM p WHERE length(value) >= CASE kind WHEN 'assign' THEN 6 WHEN 'access' THEN 20 WHEN 'hex' THEN 24 ELSE 14 END),
o AS (SELECT value, count(DISTINCT owner) >= 5 OR count(DISTINCT struct_pack(a := owner, b := coalesce(CAST(doc_id AS VARCHAR), ''))) >= 50 AS copied FROM c JOIN t ON t.rid = c.rid GROUP BY value),
v AS (SELECT value, kind, CAST(length(value) AS DOUBLE) AS n, list_transform(list_distinct(string_split(value, '')), lambda y: CAST(length(value) - length(replace(value, y, '')) AS DOUBLE)) AS counts,
  regexp_replace(lower(regexp_replace(value, '^(?:AKIA|gh[opsu]_|xox[abprs]-|[sr]k_live_|AIza)', '')), '{filler}', '', 'g') = '' OR length(value) >= 20 AND (regexp_matches(value, 'EXAMPLE(?:KEY)?$')
    OR len(list_filter(range(1, 17), lambda y: length(value) % y = 0 AND length(value) > y AND value = repeat(value[1:y], length(value) // y))) > 0) AS filler FROM (SELECT DISTINCT value, kind FROM c)),
e AS (SELECT value, kind, NOT filler AND round(-list_sum(list_transform(counts, lambda y: y / n * log2(y / n))), 9) >= round(0.6 * log2(least(n, CASE kind WHEN 'access' THEN 32 WHEN 'hex' THEN 16 ELSE 64 END)), 9) AS random FROM v),
j AS (SELECT c.*, copied, NOT copied AND random AS live FROM c JOIN o ON o.value = c.value JOIN e ON e.value = c.value AND e.kind = c.kind),
a AS (SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE live) AS n_live, count(*) FILTER (WHERE copied) AS n_copied,
  string_agg({shown}) FILTER (WHERE kind <> 'provider') AS base, string_agg({shown}) FILTER (WHERE kind <> 'provider' OR live) AS spans FROM j GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied FROM t LEFT JOIN a ON a.rid = t.rid
"""


def _licenses() -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    base = " UNION ALL ".join(f"SELECT rid, i, '{lb}' AS label FROM g WHERE g{len(p.split())} = '{p}'" for p, lb in PHRASES.items())
    notices = ", ".join(f"({n}, '{lb}', '{t}')" for n, (lb, t) in enumerate((lb, t) for lb, ts in TEMPLATES.items() for t in ts))
    gram = lambda n, w, i: " || ' ' || ".join(f"{w}[{i} + {d}]" for d in range(1, n + 1))
    return f"""
WITH RECURSIVE t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
u AS (SELECT rid, w, unnest(range(0, len(w))) AS i FROM t), g AS (SELECT rid, i, {gram(2, 'w', 'i')} AS g2, {gram(3, 'w', 'i')} AS g3, {gram(K, 'w', 'i')} AS gk FROM u), b AS ({base}),
n AS (SELECT template, label, string_split(body, ' ') AS w FROM (VALUES {notices}) AS v(template, label, body)),
q AS (SELECT template, label, len(w) AS size, j, {gram(K, 'w', 'j')} AS gk FROM (SELECT *, unnest(range(0, len(w) - {K - 1})) AS j FROM n)),
v AS (SELECT rid, template, label, size, i - j AS d, count(DISTINCT j) AS votes FROM g JOIN q ON g.gk = q.gk GROUP BY rid, template, label, size, i - j),
l AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY rid, template ORDER BY d) <= {NEIGHBOURS} THEN 0 ELSE 1 END AS new FROM v),
r AS (SELECT *, sum(new) OVER (PARTITION BY rid, template ORDER BY d) AS run FROM l),
m AS (SELECT rid, template, label, size, run, greatest(min(d) - {NEIGHBOURS}, 0) AS low FROM r GROUP BY rid, template, label, size, run HAVING sum(votes) >= {LEAST} * (size - {K - 1})),
x AS (SELECT m.*, n.w AS body, t.w[low + 1:low + 2 * (size + {NEIGHBOURS})] AS near FROM m JOIN n ON n.template = m.template JOIN t ON t.rid = m.rid),
step AS (SELECT rid, template, label, size, run, body, near, 0 AS k, 0 AS p, {NEIGHBOURS} AS missed, 0 AS hits, -1 AS first, -1 AS last FROM x UNION ALL
  SELECT rid, template, label, size, run, body, near, k + 1, p + pos, CASE WHEN pos > 0 THEN 0 ELSE missed + 1 END, hits + CASE WHEN pos > 0 THEN 1 ELSE 0 END,
    CASE WHEN pos > 0 AND first < 0 THEN p + pos ELSE first END, CASE WHEN pos > 0 THEN p + pos ELSE last END
  FROM (SELECT *, CAST(coalesce(list_position(near[p + 1:p + {NEIGHBOURS} + 1 + missed], body[k + 1]), 0) AS INTEGER) AS pos FROM step WHERE k < size)),
f AS (SELECT rid, label, CAST(hits AS DOUBLE) / greatest(size, last - first + 1) AS share FROM step WHERE k = size AND CAST(hits AS DOUBLE) / greatest(size, last - first + 1) >= {VERIFY}), z AS (SELECT rid, max(share) AS share FROM f GROUP BY rid),
y AS (SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rid, label FROM b UNION SELECT rid, label FROM f) GROUP BY rid),
h AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(greatest(coalesce(share, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END) AS DOUBLE) AS score
FROM t LEFT JOIN h ON h.rid = t.rid LEFT JOIN y ON y.rid = t.rid LEFT JOIN z ON z.rid = t.rid
"""


SECRETS, LICENSES = _secrets(), _licenses()


def _mixing() -> str:
    cases = " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS.items())
    out, above, parts = "", "root", []
    for level in LEVELS:
        parent, parts = list(parts), [*parts, level]
        keys = ", ".join(parts)
        group = f"PARTITION BY {', '.join(parent)}" if parent else ""
        on = " AND ".join(f"k.{p} = {above}.{p}" for p in parent) or "true"
        path = " || '/' || ".join(f"k.{p}" for p in parts)
        out += f"""
n_{level} AS (SELECT k.*, {above}.budget AS b, CAST(CASE {path} {cases} ELSE 1 END AS HUGEINT) AS w FROM (SELECT {keys}, sum(s) AS s FROM leaf GROUP BY {keys}) k JOIN {above} ON {on}),
o_{level} AS (SELECT *, sum(s) OVER ({group} ORDER BY CAST(s AS DOUBLE) / CAST(w AS DOUBLE), {keys}) - s AS before, sum(w) OVER ({group}) - sum(w) OVER ({group} ORDER BY CAST(s AS DOUBLE) / CAST(w AS DOUBLE), {keys}) + w AS open_w FROM n_{level}),
f_{level} AS (SELECT *, (b - before) * w >= s * open_w AS filled FROM o_{level}),
u_{level} AS (SELECT *, coalesce(sum(s) FILTER (WHERE filled) OVER ({group}), 0) AS used, sum(w) FILTER (WHERE NOT filled) OVER ({group}) AS share_w FROM f_{level}),
{level}_b AS (SELECT {keys}, CAST(CASE WHEN filled THEN s ELSE least(s, ((b - used) * w) // share_w) END AS HUGEINT) AS budget FROM u_{level}),"""
        above = f"{level}_b"
    keys = ", ".join(LEVELS)
    return f"""
WITH t AS (SELECT doc_id, CASE WHEN regexp_matches(coalesce(source, ''), '[13579]$') THEN 'reference' ELSE 'web' END AS domain, coalesce(lang, '') AS language, coalesce(source, '') AS source,
  CAST(greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+'))) AS BIGINT) AS n FROM documents),
leaf AS (SELECT {keys}, CAST(sum(n) AS HUGEINT) AS tokens, CAST(sum(n) * {EPOCHS} AS HUGEINT) AS s FROM t GROUP BY {keys}),
root AS (SELECT CAST(least(sum(tokens) * {BUDGET} // 1000, sum(tokens) * {EPOCHS}) AS HUGEINT) AS budget FROM leaf),{out}
p AS (SELECT {keys}, budget // tokens AS passes, budget % tokens AS rest FROM leaf JOIN source_b USING ({keys})),
m AS (SELECT t.*, passes, rest, md5('{SEED}:' || passes || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place FROM t JOIN p USING ({keys})),
c AS (SELECT *, CAST(passes AS BIGINT) + CASE WHEN sum(n) OVER (PARTITION BY {keys} ORDER BY place, doc_id, n ROWS UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies FROM m)
SELECT doc_id, {keys}, n AS n_tokens, CAST(copies AS BIGINT) AS copies FROM c WHERE copies > 0
"""


MIXING = _mixing()
