"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from tessera.llm.license_scan import PHRASES, TEMPLATES
from tessera.llm.quality_risk import LEVELS, RULES
from tessera.llm.url_reputation import LEAST_STRENGTH, MOST_STRENGTH, TWO_LABEL_SUFFIXES, URL

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def low(x: str) -> str:
    return f"translate({x}, '{UPPER}', '{LOWER}')"


def op1(rules, z: float = 1.0, factor: float = 1.0) -> str:
    fits = " ".join(
        f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '/{p}') THEN '{{{k}}}'"
        for k, (_, h, p) in enumerate(sorted(rules, key=lambda r: -len(r[1]) - len(r[2])))
    )
    ordered = sorted(rules, key=lambda r: -len(r[1]) - len(r[2]))
    rule, action = fits, fits
    for k, (what, h, p) in enumerate(ordered):
        rule, action = rule.replace(f"{{{k}}}", f"{h}/{p}"), action.replace(f"{{{k}}}", what)

    def kappa(level: str) -> str:
        rho = "((s / (v / pages) - members) / (pages - members))"
        return f"""(SELECT coalesce(round(greatest({LEAST_STRENGTH}, least({MOST_STRENGTH},
            CASE WHEN pages > members AND v > 0 AND {rho} > 0 THEN 1 / {rho} - 1 ELSE {MOST_STRENGTH} END)), 6), {MOST_STRENGTH})
            FROM (SELECT sum(n * (k / n - m) * (k / n - m)) s, sum(n * m * (1 - m)) v, sum(n)::double pages, count(*)::double members
                  FROM {level} WHERE n > 0))"""

    two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    return f"""
WITH p AS (SELECT page_id, coalesce({low(f"regexp_extract(url, '{URL}', 1)")}, '') host, coalesce(regexp_extract(url, '{URL}', 2), '') path FROM pages),
l AS (SELECT doc_id page_id, max(CASE WHEN coalesce(quality = 0, false) OR coalesce(toxic = 1, false) THEN 1 ELSE 0 END) bad
      FROM labels WHERE quality IS NOT NULL OR toxic IS NOT NULL GROUP BY 1),
h0 AS (SELECT host, count(bad) n, coalesce(sum(bad), 0) k FROM p LEFT JOIN l USING (page_id) GROUP BY host),
h1 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '\\.$', '') bare FROM h0),
h2 AS (SELECT *, regexp_matches(bare, '^[0-9.]+$|\\]$') ip, array_to_string(string_split(bare, '.')[-2:], '.') last2 FROM h1),
h3 AS (SELECT *, CASE WHEN ip THEN bare WHEN last2 IN ({two}) THEN array_to_string(string_split(bare, '.')[-3:], '.') ELSE last2 END AS domain FROM h2),
h AS (SELECT host, n, k, domain, CASE WHEN ip OR domain NOT LIKE '%.%' THEN '' ELSE regexp_replace(domain, '^[^.]*\\.', '') END suffix FROM h3),
s0 AS (SELECT suffix, sum(n) n, sum(k) k, (SELECT (sum(k) + 0.5) / (sum(n) + 1) FROM h) m FROM h GROUP BY 1),
s AS (SELECT suffix, (k + kappa * m) / (n + kappa) m FROM (SELECT *, {kappa('s0')} kappa FROM s0)),
d0 AS (SELECT domain, suffix, sum(h.n) n, sum(h.k) k, any_value(m) m FROM h JOIN s USING (suffix) GROUP BY 1, 2),
d AS (SELECT domain, suffix, (k + kappa * m) / (n + kappa) m FROM (SELECT *, {kappa('d0')} kappa FROM d0)),
v0 AS (SELECT host, n, k, m FROM h JOIN d USING (domain, suffix)),
v1 AS (SELECT host, k + kappa * m a, n - k + kappa * (1 - m) b FROM (SELECT *, {kappa('v0')} kappa FROM v0)),
v AS (SELECT host, CASE WHEN round(a / (a + b) - {z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 9) > round({factor} * (SELECT (sum(k) + 0.5) / (sum(n) + 1) FROM h), 9) THEN 'block' ELSE 'allow' END by_host FROM v1)
SELECT page_id, host, path, CASE {rule} END AS rule, coalesce(CASE {action} END, by_host) AS verdict FROM p LEFT JOIN v USING (host)
"""


OP2 = f"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, string_split(coalesce(text, ''), chr(10)) ls FROM documents),
x AS (SELECT rid, doc_id, u.i, ls[u.i] line FROM d, unnest(range(1, len(ls) + 1)) u(i)),
k AS (SELECT *, {low("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} key FROM x),
c AS (SELECT key, min(doc_id) first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, c.key IS NOT NULL AND coalesce(doc_id <> first, false) lost FROM k LEFT JOIN c USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT lost), '')) AS kept_sha256
FROM m GROUP BY rid
"""

OP3 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
r AS (SELECT digest, max(page_id) response FROM p WHERE n >= 1000 GROUP BY 1)
SELECT page_id, n::bigint AS payload_bytes, digest AS payload_digest,
       CASE WHEN response IS NULL OR page_id = response THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> response THEN response END AS refers_to
FROM p LEFT JOIN r USING (digest)
"""


def op9(alpha: float = 0.05, delta: float = 0.05) -> str:
    space = r"\x20\x09-\x0D"
    above = [" OR ".join(f"coalesce(({e}) > {cs[j]}, false)" for e, cs in RULES.values()) for j in range(LEVELS)]
    counts = ", ".join(f"count(*) FILTER ({x}) AS k_{j}" for j, x in enumerate(above))

    def passed(k: str) -> str:
        term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({alpha}) + (n - i) * ln(1 - {alpha}))"
        return f"{k} < {alpha} * n AND list_sum(list_transform(range(0, {k} + 1), lambda i: {term})) <= {delta} / (SELECT count(*) FROM c)"

    best = "greatest(" + ", ".join(f"CASE WHEN {passed(f'k_{j}')} THEN {j} END" for j in range(LEVELS)) + ")"
    over = "CASE level " + " ".join(f"WHEN {j} THEN {x}" for j, x in enumerate(above)) + " ELSE false END"
    return f"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^{space}]+') AS w FROM d),
g AS (SELECT rid, u.i, w[u.i] || chr(10) || w[u.i + 1] || chr(10) || w[u.i + 2] AS g FROM w, unnest(range(1, len(w) - 1)) u(i)),
t AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) n FROM g) WHERE n > 1),
r AS (SELECT rid, count(DISTINCT i + j) n FROM t, unnest([0, 1, 2]) u(j) GROUP BY rid),
l AS (SELECT rid, count(*) n, count(*) - count(DISTINCT line) dup FROM (SELECT rid, unnest(string_split(text, chr(10))) line FROM d) WHERE regexp_matches(line, '[^{space}]') GROUP BY rid),
f AS (SELECT doc_id, coalesce('=' || lang, 'null') stratum, len(w)::bigint n_words, length(regexp_replace(text, '[{space}]', '', 'g'))::bigint word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, coalesce(l.dup, 0)::bigint n_dup_lines, coalesce(r.n, 0)::bigint n_repeat_words,
      coalesce(l.n, 0)::bigint n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g'))::bigint n_capitals
      FROM w LEFT JOIN l USING (rid) LEFT JOIN r USING (rid)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f),
q AS (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY 1 HAVING min(quality) = 1),
c AS (SELECT stratum, count(*) n, {counts} FROM b JOIN q USING (doc_id) WHERE NOT base_failed GROUP BY 1),
k AS (SELECT stratum, {best} AS level FROM c)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_capitals, base_failed,
       NOT base_failed AND NOT ({over}) AS kept
FROM b LEFT JOIN k USING (stratum)
"""


def op10(gap: int = 3, coverage: float = 0.8) -> str:
    rows = ", ".join(f"({k}, '{t}', '{label}', {phrase})" for k, (t, label, phrase) in enumerate([(*p, True) for p in PHRASES] + [(*t, False) for t in TEMPLATES]))
    return rf"""
WITH d AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all({low("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT rid, u.i - 1 AS place, w[u.i] || ' ' || w[u.i + 1] || ' ' || w[u.i + 2] AS g FROM d, unnest(range(1, len(w) - 1)) u(i)),
t AS (SELECT id, label, phrase, string_split(words, ' ') w FROM (VALUES {rows}) v(id, words, label, phrase)),
tg AS (SELECT id, label, phrase, len(w) - 2 AS n, u.i - 1 AS t_place, w[u.i] || ' ' || w[u.i + 1] || ' ' || w[u.i + 2] AS g FROM t, unnest(range(1, len(w) - 1)) u(i)),
h AS (SELECT rid, id, label, phrase, n, t_place, place, place - t_place AS diagonal FROM g JOIN tg USING (g)),
base AS (SELECT rid, label, diagonal AS place FROM h WHERE phrase GROUP BY rid, id, label, n, diagonal HAVING count(*) = n),
a AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY rid, id ORDER BY diagonal, t_place) <= {gap} THEN 0 ELSE 1 END apart FROM h WHERE NOT phrase),
i AS (SELECT *, sum(apart) OVER (PARTITION BY rid, id ORDER BY diagonal, t_place) island FROM a),
m AS (SELECT rid, label, count(DISTINCT t_place) / n AS score FROM i GROUP BY rid, id, label, n, island
      HAVING count(DISTINCT t_place) / n >= {coverage} AND max(place) - min(place) + 3 <= 1.5 * (n + 2)),
o AS (SELECT rid, id, island FROM i GROUP BY rid, id, n, island HAVING count(DISTINCT t_place) / n >= {coverage} AND max(place) - min(place) + 3 > 1.5 * (n + 2)),
s AS (SELECT x.rid, x.label, count(DISTINCT y.t_place) / x.n AS score FROM (SELECT DISTINCT rid, id, label, n, island, diagonal FROM i SEMI JOIN o USING (rid, id, island)) x
      JOIN i y ON y.rid = x.rid AND y.id = x.id AND y.island = x.island AND y.diagonal BETWEEN x.diagonal AND x.diagonal + (x.n + 2) // 2
      GROUP BY x.rid, x.id, x.label, x.n, x.island, x.diagonal HAVING count(DISTINCT y.t_place) / x.n >= {coverage}),
r AS (SELECT rid, count(*) FILTER (base) n_base, min(place) FILTER (base) first_word, max(place) FILTER (base) last_word,
      string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) base_labels, string_agg(DISTINCT label, ',' ORDER BY label) labels, max(score) score
      FROM (SELECT rid, label, place, true base, 1.0::double score FROM base UNION ALL SELECT rid, label, NULL, false, score FROM m UNION ALL SELECT rid, label, NULL, false, score FROM s) GROUP BY rid)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_base, 0)::bigint AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0)::double AS score
FROM d LEFT JOIN r USING (rid)
"""
