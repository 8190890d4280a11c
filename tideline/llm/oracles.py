"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

URLS = r"""
WITH p AS (
  SELECT page_id, TIMESTAMP '2024-01-01' + to_minutes(((page_id * 37) % 432000)::BIGINT) AS fetched_at,
    regexp_replace(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://([^/?#]*)', 1), '^.*@', ''), ':[0-9]*$', '') AS host,
    regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/+$', '') AS path
  FROM pages
), h AS (SELECT host, min(page_id) AS m, arg_min(host || path, (page_id, host || path)) AS first, 'd:' || regexp_replace(host, '^[^.]*[.]', '') AS parent FROM p WHERE host <> '' GROUP BY host),
e AS (
  SELECT 'abuse' AS list, 'block' AS verdict, 'd:' || host AS pattern, m % 200 AS d, 'add' AS action FROM h WHERE m % 7 < 3
  UNION ALL SELECT 'abuse', 'block', 'd:' || host, m % 200 + 60, 'remove' FROM h WHERE m % 7 < 3 AND m % 3 = 0
  UNION ALL SELECT 'abuse', 'block', 'd:' || host, m % 200 + 90, 'add' FROM h WHERE m % 7 < 3 AND m % 6 = 0
  UNION ALL SELECT 'regional', 'block', parent, m % 50 + 20, 'add' FROM h WHERE host LIKE '%.%.%.%' AND m % 5 = 1
  UNION ALL SELECT 'regional', 'block', parent, m % 50 + 90, 'remove' FROM h WHERE host LIKE '%.%.%.%' AND m % 5 = 1
  UNION ALL SELECT 'paths', 'block', 'p:' || host || '/de', m % 100, 'add' FROM h WHERE m % 4 = 0
  UNION ALL SELECT 'deep', 'block', 'p:' || array_to_string(string_split(first, '/')[1:4], '/'), m % 120, 'add' FROM h WHERE m % 3 = 1 AND first LIKE '%/%'
  UNION ALL SELECT 'trusted', 'allow', 'd:' || host, m % 100 + 30, 'add' FROM h WHERE m % 7 = 1
  UNION ALL SELECT 'trusted', 'allow', 'd:' || host, m % 100 + 150, 'remove' FROM h WHERE m % 14 = 1
), a AS (
  SELECT list, pattern, TIMESTAMP '2024-01-01' + to_days(d::INTEGER) AS since, max(action) AS action, min(verdict) AS verdict FROM e GROUP BY list, pattern, d
), v AS (
  SELECT *, lead(since, 1, TIMESTAMP '9999-12-31') OVER (PARTITION BY list, pattern ORDER BY since) AS valid_to FROM a
), s AS (SELECT page_id, fetched_at, string_split(host, '.') AS labels, string_split(host || path, '/') AS parts, host || path AS address FROM p WHERE host <> ''),
k AS (
  SELECT DISTINCT page_id, fetched_at, unnest(list_concat(list_concat(
    list_transform(range(1, greatest(len(labels) - 1, 1) + 1), lambda i: 'd:' || array_to_string(labels[i:], '.')),
    list_transform(range(1, len(parts)), lambda i: 'p:' || array_to_string(parts[1:i + 1], '/'))), ['u:' || address])) AS pattern
  FROM s
), m AS (
  SELECT page_id, verdict, list, pattern, v.since AS valid_from, count(*) OVER (PARTITION BY page_id) AS n_active,
    row_number() OVER (PARTITION BY page_id ORDER BY length(pattern) DESC, verdict, list, pattern, v.since) AS r
  FROM k JOIN v USING (pattern) WHERE action = 'add' AND fetched_at >= v.since AND fetched_at < v.valid_to
)
SELECT p.page_id, p.fetched_at, coalesce(verdict, 'allow') <> 'block' AS allowed, verdict, list, pattern, valid_from, coalesce(n_active, 0) AS n_active
FROM p LEFT JOIN m ON m.page_id = p.page_id AND r = 1
"""

COPIES = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""

RULES = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{WORD}+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) > 4)),
f AS (SELECT doc_id, unnest(list(i)) AS i FROM g GROUP BY doc_id, gram HAVING count(*) > 1),
r AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM f, range(0, 5) AS o(j) GROUP BY doc_id),
b AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')))) AS n_dup_lines,
    coalesce(r.n, 0) AS n_repeat_words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS upper, length(t) - length(regexp_replace(t, '[A-Za-z]', '', 'g')) AS letters,
    coalesce(list_max(list_transform(ws, lambda x: strlen(x))), 0) AS longest
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
  NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words OR 100 * n_symbols > 20 * n_words OR (letters >= 40 AND 100 * upper > 70 * letters)
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR longest > 1000 OR 10 * n_dup_lines > greatest(n_words, 50)) AS kept
FROM b
"""

MIX = rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}+'))::BIGINT AS tokens, md5('1|' || doc_id) AS ord FROM documents),
s AS (SELECT source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY source),
tot AS (SELECT sum(tokens)::DOUBLE AS total, ln(count(*)::DOUBLE) AS even FROM s WHERE tokens > 0),
p AS (SELECT tokens / total AS p FROM s, tot WHERE tokens > 0),
e AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN good THEN lo ELSE (lo + hi) / 2 END, CASE WHEN good THEN (lo + hi) / 2 ELSE hi END FROM (
    SELECT step, lo, hi, ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) <= 0.95 * max(even) AS good
    FROM e, p, tot WHERE step < 50 GROUP BY step, lo, hi)
), l AS (
  SELECT 0 AS step, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi
  UNION ALL
  SELECT step + 1, CASE WHEN good THEN lo ELSE (lo + hi) / 2 END, CASE WHEN good THEN (lo + hi) / 2 ELSE hi END FROM (
    SELECT step, lo, hi, pow(min(p), (lo + hi) / 2) / sum(pow(p, (lo + hi) / 2)) / min(p) <= 4.0 AS good FROM l, p WHERE step < 50 GROUP BY step, lo, hi)
), alpha AS (
  SELECT round(greatest(CASE WHEN (SELECT -sum(p * ln(p)) FROM p) >= 0.95 * (SELECT even FROM tot) THEN 1.0 ELSE (SELECT hi FROM e WHERE step = 50) END,
    CASE WHEN (SELECT 1.0 / count(*) / min(p) FROM p) <= 4.0 THEN 0.0 ELSE (SELECT hi FROM l WHERE step = 50) END), 6) AS alpha
), w AS (
  SELECT source, tokens, CASE WHEN tokens > 0 THEN round(pow(tokens / total, alpha) / (SELECT sum(pow(p, alpha)) FROM p, alpha), 6) ELSE 0.0 END AS weight, total FROM s, tot, alpha
), q AS (SELECT source, tokens, weight, floor(weight * total + 1e-6)::BIGINT AS quota FROM w),
t AS (SELECT *, CASE WHEN tokens > 0 THEN quota // tokens ELSE 1 END AS passes FROM q),
u AS (SELECT source, weight, quota, passes, CASE WHEN tokens > 0 THEN quota - passes * tokens ELSE 0 END AS rest FROM t),
k AS (SELECT *, ('0x' || substr(ord, 1, 8))::BIGINT % 1024 AS block FROM d),
b AS (SELECT source, block, sum(tokens)::BIGINT AS t FROM k GROUP BY source, block),
o AS (
  SELECT b.source, block, t, weight, quota, passes, rest,
    coalesce(sum(t) OVER (PARTITION BY b.source ORDER BY md5('1|' || b.source || '|' || block || '|' || passes), block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM b JOIN u ON u.source = b.source
)
SELECT k.doc_id, k.source, k.tokens, weight, quota, k.block, passes + CASE WHEN k.tokens = 0 THEN 0 WHEN before + t <= rest THEN 1
  WHEN before < rest AND sum(k.tokens) OVER (PARTITION BY k.source, k.block ORDER BY k.ord, k.doc_id, k.tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= rest - before THEN 1 ELSE 0 END AS copies
FROM k JOIN o ON o.source = k.source AND o.block = k.block
"""

#: crc32 of a decimal number's text, bit by bit.
CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split({x}::VARCHAR, ''), lambda c: [ord(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
  lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))))"""


def _leaf(n_chars: str = "n_chars") -> str:
    one = "coalesce(strlen({0}::VARCHAR) || ':' || {0}::VARCHAR, '-')"
    return "sha256(" + " || ".join(one.format(c) for c in ("doc_id", "source", "lang", f"({n_chars})", "text")) + ")"


MANIFEST = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce('=' || lang, '') AS tree, {_leaf()} AS leaf, {_leaf(f"n_chars + CASE WHEN {CRC.format(x='doc_id')} % 7 = 0 THEN 1 ELSE 0 END")} AS other FROM documents
), p AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, other) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM d),
t AS (
  SELECT tree, 0 AS lvl, pos, n, leaf AS h FROM p
  UNION ALL SELECT tree, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY tree, lvl, pos // 2, n
), s AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (
  SELECT 0 AS lvl, pos, n, subroot AS h FROM s
  UNION ALL SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 2, n
), c AS (
  SELECT k, tree, 0 AS lvl, pos, n, other AS acc, '' AS seen FROM p
  UNION ALL SELECT k, c.tree, c.lvl + 1, c.pos // 2, (c.n + 1) // 2, sha256(CASE WHEN t.h IS NULL THEN acc WHEN t.pos < c.pos THEN t.h || acc ELSE acc || t.h END), seen || coalesce(t.h, '')
  FROM c LEFT JOIN t ON t.tree = c.tree AND t.lvl = c.lvl AND t.pos = xor(c.pos, 1) WHERE c.n > 1
), e AS (
  SELECT k, 0 AS lvl, s.pos, s.n, acc, seen FROM c JOIN s ON s.tree = c.tree WHERE c.n = 1
  UNION ALL SELECT k, e.lvl + 1, e.pos // 2, (e.n + 1) // 2, sha256(CASE WHEN u.h IS NULL THEN acc WHEN u.pos < e.pos THEN u.h || acc ELSE acc || u.h END), seen || coalesce(u.h, '')
  FROM e LEFT JOIN u ON u.lvl = e.lvl AND u.pos = xor(e.pos, 1) WHERE e.n > 1
)
SELECT doc_id, leaf, subroot, u.h AS root, sha256(seen) AS proof_sha256, acc AS folded_root, acc = u.h AS verified
FROM p JOIN s USING (tree) JOIN e ON e.k = p.k AND e.n = 1 JOIN u ON u.n = 1
"""

CALLS = "tel|phone|call|fax|mobile|cell|telefon|ruf|llam|appel|sms"
DIGITS_OF = "regexp_replace(hit, '[^0-9]', '', 'g')"
LUHN = f"length({DIGITS_OF}) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse({DIGITS_OF}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN c::INT * 2 - 9 ELSE c::INT * 2 END)) % 10 = 0"
OCTETS = r"regexp_matches(hit, '^(0*(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})([.]|$)){4}$')"


def _kind(name: str, pattern: str, start: int, valid: str, helps: str, harms: str, base: bool = True, left: str = "", right: str = "", end: str = "hit") -> str:
    """Rows (doc_id, place, kind, start, end, score, base) of one kind."""
    sides = (f" AND NOT regexp_matches(before, '{left}\\z')" if left else "") + (f" AND NOT regexp_matches(behind, '^{right}')" if right else "")
    near = "lower(right(before, 40) || ' ' || left(behind, 20))"
    return f"""
SELECT doc_id, k, '{name}' AS kind, pos AS a, pos + length({end}) AS b, least(100, {start} + CASE WHEN regexp_matches({near}, '{helps}') THEN 30 ELSE 0 END - CASE WHEN regexp_matches({near}, '{harms}') THEN 25 ELSE 0 END) AS score, {base} AS base
FROM (SELECT doc_id, k, hits[i] AS hit, gaps[i] AS before, gaps[i + 1] AS behind, list_sum(list_transform(gaps[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[:i - 1], lambda x: length(x))), 0) AS pos
  FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM (SELECT doc_id, k, regexp_extract_all(t, '{pattern}') AS hits, regexp_split_to_array(t, '{pattern}') AS gaps FROM d)))
WHERE ({valid}){sides}"""


_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 "
    "GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 "
    "PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
CUT = f"regexp_extract(hit, '^([A-Z0-9] ?){{' || (coalesce(try_cast(regexp_extract('{_LENGTHS}', left(hit, 2) || '([0-9]{{2}})', 1) AS INT), 500) - 1) || '}}[A-Z0-9]')"
MOD97 = f"""CUT <> '' AND list_reduce(list_concat([0], list_transform(string_split(regexp_replace(substr(CUT, 5) || left(CUT, 4), ' ', '', 'g'), ''), lambda c: CASE WHEN c >= 'A' THEN ord(c) - 55 ELSE ord(c) - 48 END)),
  lambda a, v: CASE WHEN v > 9 THEN (a * 100 + v) % 97 ELSE (a * 10 + v) % 97 END) = 1"""
KINDS = ["email", "ip", "card", "phone", "iban", "ssn", "tel"]
PERSONAL = " UNION ALL ".join([
    _kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:[.][A-Za-z0-9-]+)+", 60, "true", "mail|contact|write|kontakt|correo|courriel", "example|beispiel|ejemplo|exemple"),
    _kind("ip", "[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+", 60, OCTETS, "(^|[^a-z])ip([^a-z]|$)|address|host|server|adresse|client", "version|section|chapter|release"),
    _kind("card", "[0-9](?:[ -]?[0-9])+", 70, LUHN, "card|visa|master|credit|karte|tarjeta|carte", "order|isbn|serial|tracking|parcel"),
    _kind("phone", "[+][0-9][ ().0-9-]+[0-9]", 60, f"length({DIGITS_OF}) BETWEEN 9 AND 15", CALLS, "order|isbn|serial|score"),
    _kind("iban", "[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)", 75, MOD97.replace("CUT", "cut"), "iban|account|bank|konto|cuenta|compte", "example|serial", False, "[A-Za-z0-9]", end="cut").replace("hits[i] AS hit,", "hits[i] AS hit, " + CUT.replace("hit,", "hits[i],") + " AS cut,"),
    _kind("ssn", "[0-9]{3}-[0-9]{2}-[0-9]{4}", 30, "NOT regexp_matches(hit, '^(000|666|9)|-00-|-0000$')", "ssn|social|security|tax", "order|part|serial", False, "[0-9-]", "[0-9-]"),
    _kind("tel", "[(]?0[1-9][0-9]{1,3}[)]?[ /.-]?[0-9]{3,4}[ .-]?[0-9]{3,4}", 30, f"length({DIGITS_OF}) BETWEEN 9 AND 12", CALLS, "order|isbn|serial|article", False, "[0-9+().-]", "[0-9]"),
])
_COUNTS = ", ".join(f"coalesce(count(*) FILTER (kind = '{k}'), 0) AS n_{k}" for k in KINDS)
_ORDER = f"list_position({KINDS}, kind), a"
PII = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents), s AS ({PERSONAL}), f AS (SELECT * FROM s WHERE base OR score >= 50)
SELECT d.doc_id, {_COUNTS}, sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY {_ORDER}) FILTER (base), '')) AS base_sha256,
  coalesce(string_agg(kind || ':' || a || ':' || b, ',' ORDER BY {_ORDER}), '') AS spans, coalesce(string_agg(score::VARCHAR, ',' ORDER BY {_ORDER}), '') AS scores
FROM d LEFT JOIN f ON f.k = d.k GROUP BY d.k, d.doc_id
"""

ORACLES = {"op1_url_filters": URLS, "op5_exact_dedup": COPIES, "op6_mixing": MIX, "op7_quality_rules": RULES, "op11_pii": PII, "op13_merkle_manifest": MANIFEST}
