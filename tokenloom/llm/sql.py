"""DuckDB SQL for the queries that SQL can express, on the same tables.

Not here: fingerprints need XXH64, and token ids, counts and packing the tokenizers' vocabularies; tests/llm holds
those against brute-force versions.
"""

from __future__ import annotations

from tokenloom.llm.pii import AGAINST, BASE_SCORES, CONTEXT, DROP, LIFT, REACH
from tokenloom.llm.quality import BARS, BOILERPLATE, ENDS, ENTRY, LAST, MAX_LOST, SHORT, SYMBOLS
from tokenloom.llm.secret_scan import BASE, RULES


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def url_filters(entries: list[tuple[str, str, str, str]]) -> str:
    cut = [(a, *b.lower().partition("/")[::2], c.lower(), d) for a, b, c, d in entries]  # the entries' paths are in lower case
    rows = ", ".join(f"({_quoted(a)}, {_quoted(host.rstrip('.'))}, {_quoted(('/' + path).rstrip('/'))}, {_quoted(c)}, TIMESTAMP {_quoted(d)})" for a, host, path, c, d in cut)
    return f"""
WITH last AS (SELECT list_name, domain, prefix, ts, max(action) AS action FROM (VALUES {rows}) e(list_name, domain, prefix, action, ts) GROUP BY ALL),
turns AS (SELECT * FROM (SELECT *, lag(action, 1, 'remove') OVER w AS was FROM last WINDOW w AS (PARTITION BY list_name, domain, prefix ORDER BY ts)) WHERE action <> was),
spans AS (SELECT * FROM (SELECT list_name, domain, prefix, action, ts AS valid_from, lead(ts) OVER (PARTITION BY list_name, domain, prefix ORDER BY ts) AS valid_to FROM turns) WHERE action = 'add'),
p AS (SELECT page_id, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[0-9A-Fa-f:.]+\\]|[^\\[\\]/:?#]+)(?::[0-9]*)?(?:[/?#]|$)', 1)), '.'), '') AS host,
  regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)', 1) AS path,
  TIMESTAMP '2024-01-01 00:00:00' + to_hours(CAST((page_id * 7919) % 8784 AS BIGINT)) AS fetched FROM pages)
SELECT page_id, host, strftime(fetched, '%Y-%m-%d %H:%M:%S') AS fetched, count(domain) AS n_active,
  coalesce(string_agg(DISTINCT list_name, ',' ORDER BY list_name), '') AS active_lists, count(domain) > 0 AS blocked
FROM p LEFT JOIN spans ON (host = domain OR ends_with(host, '.' || domain)) AND valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to) AND (prefix = '' OR path = prefix OR starts_with(path, prefix || '/'))
GROUP BY page_id, host, fetched"""


WARC = """
WITH b AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
d AS (SELECT page_id, octet_length(p) AS n, sha1(p) AS h, min(page_id) OVER (PARTITION BY p) AS holder FROM b)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS INTEGER) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to FROM d"""

_WORD = r"[^\x20\x09-\x0D]+"


def quality() -> str:
    count = lambda x, pattern: f"len(regexp_extract_all({x}, {_quoted(pattern)}))"
    blanks = lambda x: f"length(regexp_replace({x}, '[\\x20\\x09-\\x0D]', '', 'g'))"
    n, has = count("l", _WORD), lambda pattern: f"regexp_matches(l, {_quoted(pattern)})"
    bars, symbols, shouts, commas = (count("l", x) for x in (BARS, SYMBOLS, "!", ","))
    entry = f"(length(l) <= {40 * ENTRY} AND {has(_WORD)} AND NOT {has(LAST)} AND {n} <= {ENTRY})"
    fails = f"""(NOT {has(ENDS)} AND {n} >= 3 OR {bars} >= 3 AND {n} <= 5 * ({bars} + 1) OR {symbols} * 3 >= {n} AND {symbols} >= 3 OR {shouts} * 3 >= {n} AND {shouts} >= 4
      OR length(l) <= {40 * SHORT} AND (NOT {has(LAST)} AND {commas} >= 2 AND {n} <= 2 * ({commas} + 1) OR {n} <= {SHORT} AND {has(BOILERPLATE)})
      OR entry AND (coalesce(e1 AND e2, false) OR coalesce(b1 AND e1, false) OR coalesce(b1 AND b2, false)))"""
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
wins AS (SELECT doc_id, unnest(range(1, len(w) - 3)) AS i, w FROM d),
keys AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS k FROM wins),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM keys) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY 1),
cut AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
marked AS (SELECT doc_id, l, i, {entry} AS entry, {has(_WORD)} AS worded FROM cut),
lines AS (SELECT *, lag(entry, 1) OVER o AS b1, lag(entry, 2) OVER o AS b2, lead(entry, 1) OVER o AS e1, lead(entry, 2) OVER o AS e2 FROM marked WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
byline AS (SELECT doc_id, count(*) FILTER (worded) - count(DISTINCT l) FILTER (worded) AS dups, coalesce(sum({blanks("l")}) FILTER (worded AND {fails}), 0) AS lost FROM lines GROUP BY 1),
f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST({blanks("t")} AS BIGINT) AS word_chars, CAST({count("t", SYMBOLS)} AS BIGINT) AS n_symbols, CAST(dups AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(lost AS BIGINT) AS lost_chars
  FROM d JOIN byline USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND lost_chars <= {MAX_LOST} * word_chars AS kept FROM f"""


_PLAIN_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
DECONTAMINATION = f"""
WITH b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_PLAIN_WORD}') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_PLAIN_WORD}') AS w FROM documents),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM hits GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)"""


def _matches(pattern: str, group: int = 0) -> str:
    """doc_id, a (code points before), m (the match) and g (its group) of every match in d's texts t, leftmost and not overlapping."""
    found = _quoted(pattern)
    return f"""SELECT doc_id, unnest(m) AS m, unnest(g) AS g, unnest(list_transform(range(len(m)), lambda i: list_sum(list_transform(s[1:i + 1], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i], lambda x: length(x))), 0))) AS a
  FROM (SELECT doc_id, regexp_extract_all(t, {found}, 0) AS m, regexp_extract_all(t, {_quoted(f"({pattern})") if not group else found}, {group}) AS g, string_split_regex(t, {found}) AS s FROM d WHERE regexp_matches(t, {found}))"""


def secrets() -> str:
    parts = []
    for order, rule in enumerate(RULES):
        parts.append(f"""SELECT doc_id, {order} AS o, '{rule.kind}' AS kind, a, a + length(m) AS z FROM ({_matches(rule.pattern, rule.group)})
  WHERE length(g) >= {rule.least}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE)
    told = "kind || ':' || CAST(a AS BIGINT) || ':' || CAST(z AS BIGINT)"
    base = ", ".join(f"'{k}'" for k in BASE)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({" UNION ALL ".join(parts)}),
g AS (SELECT doc_id, {counts}, string_agg({told}, ',' ORDER BY a, o) FILTER (kind IN ({base})) AS base, string_agg({told}, ',' ORDER BY a, o) AS spans FROM f GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)"""


#: Personal data as the contract words it, with what each match must fulfil.
_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(length({_DIGITS})), lambda i: list_sum(list_transform(string_split(CAST(CAST(substr({_DIGITS}, CAST(length({_DIGITS}) - i AS INTEGER), 1) AS INTEGER) * (1 + i % 2) AS VARCHAR), ''), lambda x: CAST(x AS INTEGER))))) % 10 = 0"
_PERSONAL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN true ELSE coalesce(TRY_CAST(ltrim(x, '0') AS INTEGER), 0) > 255 END)) = 0"),
    "card": (r"[0-9]([\x20-]?[0-9])+", f"CASE WHEN length({_DIGITS}) BETWEEN 14 AND 19 THEN {_LUHN} ELSE false END"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 10 AND 15"),
}
_IBAN = "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"


def personal_data() -> str:
    """IBANs: at each place that may start one, the longest end at a border of groups that mod-97 confirms; of overlapping ones the first."""
    kinds = list(_PERSONAL)
    parts = [f"SELECT doc_id, {o} AS o, '{k}' AS kind, a, a + length(m) AS z FROM ({_matches(_PERSONAL[k][0])}) WHERE {_PERSONAL[k][1]}" for o, k in enumerate(kinds)]
    bare = "replace(m[1:n], ' ', '')"
    moved = f"({bare}[5:] || {bare}[1:4])"
    value = lambda x: f"(CASE WHEN {x} <= '9' THEN ord({x}) - 48 ELSE ord({x}) - 55 END)"
    rest = f"list_reduce(list_prepend(0, list_transform(string_split({moved}, ''), lambda c: {value('c')})), lambda r, v: (r * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97)"
    listed = lambda words: "[" + ", ".join(_quoted(w) for w in words) + "]"
    context = " ".join(f"WHEN kind = '{k}' THEN list_has_any(near, {listed(w)})" for k, w in CONTEXT.items())
    least = " ".join(f"WHEN kind = '{k}' THEN {round(100 * v)}" for k, v in BASE_SCORES.items())
    told = "kind || ':' || CAST(a AS BIGINT) || ':' || CAST(z AS BIGINT)"
    base = ", ".join(f"'{k}'" for k in kinds)
    return f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
starts AS (SELECT doc_id, t, unnest(range(length(t))) AS a FROM d WHERE regexp_matches(t, {_quoted(_IBAN)})),
runs AS (SELECT doc_id, a, regexp_extract(substr(t, a + 1, 80), '^({_IBAN})(?:[^A-Za-z0-9]|$)', 1) AS m FROM starts WHERE regexp_matches(substr(t, a + 1, 4), '^[A-Z]{{2}}[0-9]{{2}}$') AND (a = 0 OR NOT regexp_matches(substr(t, a, 1), '[A-Za-z0-9]'))),
ends AS (SELECT doc_id, a, m, unnest(list_filter(range(12, length(m) + 1), lambda n: n = length(m) OR m[n + 1] = ' ')) AS n FROM runs WHERE m <> ''),
good AS (SELECT doc_id, a, max(a + n) AS z FROM ends WHERE {rest} = 1 GROUP BY ALL),
ibans AS (SELECT doc_id, min_by(z, a) AS z, min(a) AS a FROM good GROUP BY 1 UNION ALL
  SELECT doc_id, z, a FROM (SELECT g.doc_id, g.z, g.a, row_number() OVER (PARTITION BY g.doc_id ORDER BY g.a) AS place FROM ibans i JOIN good g ON g.doc_id = i.doc_id AND g.a >= i.z) WHERE place = 1),
f AS ({" UNION ALL ".join(parts)} UNION ALL SELECT doc_id, {len(kinds)}, 'iban', a, z FROM ibans),
n AS (SELECT f.*, list_transform(regexp_extract_all(substr(t, CAST(greatest(a - {REACH}, 0) + 1 AS BIGINT), CAST(least(a, {REACH}) AS BIGINT)) || ' ' || substr(t, CAST(z + 1 AS BIGINT), {REACH // 2}), '[\\p{{L}}\\p{{Nl}}\\p{{No}}]+'), lambda w: lower(w)) AS near FROM f JOIN d USING (doc_id)),
s AS (SELECT *, least(100, greatest(0, CASE {least} END + CASE WHEN (CASE {context} END) THEN {round(100 * LIFT)} ELSE 0 END - CASE WHEN list_has_any(near, {listed(AGAINST)}) THEN {round(100 * DROP)} ELSE 0 END)) AS points FROM n),
g AS (SELECT doc_id, {", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in kinds)}, string_agg({told}, ',' ORDER BY a, o, z) FILTER (kind IN ({base})) AS base,
  string_agg({told}, ',' ORDER BY a, o, z) AS spans, string_agg(printf('%.2f', points / 100), ',' ORDER BY a, o, z) AS scores FROM s GROUP BY 1)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in kinds)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN g USING (doc_id)"""


def oracles(entries: list[tuple[str, str, str, str]]) -> dict[str, str]:
    return {"op1_url_filters": url_filters(entries), "op2_warc": WARC, "op4_quality_rules": quality(), "op7_decontamination": DECONTAMINATION, "op8_secret_scans": secrets(), "op10_pii": personal_data()}
