"""DuckDB SQL for the operators that SQL can express whole.

The others need hashes, trained models or iteration that SQL does not have; tests/llm/ holds them against brute
force.
"""

from __future__ import annotations

from .pii import CONTEXT, CONTEXT_BONUS, RULES, THRESHOLD

#: The same patterns as in ``pii.RULES`` for an engine without possessive quantifiers and lookaround.
_PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "local_phone": r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
}
_ALONE = "NOT regexp_matches(right(l, 1), '[A-Za-z0-9]') AND NOT regexp_matches(left(r, 1), '[A-Za-z0-9]')"
_LUHN = """list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN substr(d, length(d) - i::INT, 1)::INT
  ELSE 2 * substr(d, length(d) - i::INT, 1)::INT - CASE WHEN substr(d, length(d) - i::INT, 1)::INT > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
_MOD97 = """list_reduce(list_prepend(0, list_transform(string_split(substr(replace(m, ' ', ''), 5) || left(replace(m, ' ', ''), 4), ''),
  lambda x: CASE WHEN x <= '9' THEN x::INT ELSE ascii(x) - 55 END)), lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1"""
_VALID = {
    "email": "true",
    "ip": r"regexp_full_match(m, '(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})\.){3}0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})')",
    "card": f"length(d) BETWEEN 12 AND 19 AND {_LUHN}",
    "phone": "length(d) BETWEEN 9 AND 15",
    "iban": f"{_ALONE} AND length(replace(m, ' ', '')) BETWEEN 15 AND 34 AND {_MOD97}",
    "ssn": f"{_ALONE} AND NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$')",
    "local_phone": _ALONE,
}


def _hits() -> str:
    parts = []
    for rank, rule in enumerate(RULES):
        pattern = _PATTERNS[rule.kind]
        score = f"{rule.prior} + CASE WHEN regexp_matches(lower(right(l, {CONTEXT}) || ' ' || left(r, {CONTEXT})), '{rule.context}') THEN {CONTEXT_BONUS} ELSE 0 END"
        keep = "true" if rule.base else f"({score})::DOUBLE >= {THRESHOLD}"
        parts.append(f"""SELECT doc_id, s, {rank} AS rank, s + length(m) AS e, '{rule.kind}' AS kind, {str(rule.base).lower()} AS base FROM (
  SELECT doc_id, m, l, r, regexp_replace(m, '[^0-9]', '', 'g') AS d,
    (sum(length(l)) OVER o + sum(length(m)) OVER o - length(m))::BIGINT AS s
  FROM (SELECT doc_id, i, hits[i] AS m, segs[i] AS l, segs[i + 1] AS r FROM (
    SELECT doc_id, generate_subscripts(hits, 1) AS i, hits, segs FROM (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS hits, string_split_regex(text, '{pattern}') AS segs FROM docs)))
  WINDOW o AS (PARTITION BY doc_id ORDER BY i)) WHERE {_VALID[rule.kind]} AND {keep}""")
    return " UNION ALL ".join(parts)


OP1 = f"""WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
hits AS ({_hits()}),
kept AS (SELECT * FROM hits h WHERE base OR NOT EXISTS (SELECT 1 FROM hits b WHERE b.base AND b.doc_id = h.doc_id AND b.s < h.e AND h.s < b.e)),
sums AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
  count(*) FILTER (kind = 'phone') AS n_phone, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (base) AS b,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS a FROM kept GROUP BY ALL)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(b, '')) AS base_sha256, coalesce(a, '') AS spans FROM docs LEFT JOIN sums USING (doc_id)"""

OP6 = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5_number(substr(h, (2 * i + 1)::INT, 200)) AS k FROM (SELECT doc_id, h, unnest(range(n - 99)) AS i FROM h WHERE n >= 100)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS place FROM w),
g AS (SELECT doc_id, i, i > coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100, -1) AS opens FROM f WHERE place > 1),
s AS (SELECT doc_id, i, sum(opens::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM g),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 100 AS b FROM s GROUP BY ALL),
pieces AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS since FROM spans),
cut AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last, string_agg(substr(h, (2 * since + 1)::INT, (2 * (a - since))::INT), '' ORDER BY a) AS head FROM pieces JOIN h USING (doc_id) GROUP BY ALL)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, (2 * coalesce(last, 0) + 1)::INT))) AS kept_sha256 FROM h LEFT JOIN cut USING (doc_id)"""

OP8 = r"""WITH t AS (SELECT conv_id, turn, role, text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM t),
e AS (SELECT *, length(regexp_replace(regexp_replace(role || chr(0) || text, '(<!*)(/?s>)', '\1!\2', 'g'), '(\[!*)(/?INST\])', '\1!\2', 'g')) - 1 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(17 + chars))::BIGINT AS formatted_chars FROM e GROUP BY ALL"""


def oracle_sql() -> dict[str, str]:
    return {"op1_pii": OP1, "op6_repeats": OP6, "op8_chat": OP8}
