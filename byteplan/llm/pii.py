"""Personal data: regular expressions propose, checksums confirm, context words adjust the score.

DataFrame operations only. For each kind the text is split at its matches; running sums of the lengths
of the pieces and of the matches give code-point offsets, which Spark's own functions do not return.
The patterns are possessive and start at the edge of a run, so they are linear in the text and cannot
exhaust the stack on very long matches; both changes leave the leftmost greedy matches the same.
Sums and maxima along an array are taken in blocks (``_scans``), as an array that grows by one element at
a time is copied each time: a text with very many matches costs about as much a match as any other.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Code points of the neighbouring text that are searched for context words.
CONTEXT = 40
#: A span counts from this score on.
THRESHOLD = 0.6


@dataclass(frozen=True)
class Rule:
    """One kind of span.

    ``pattern`` is a Java regex, ``valid`` a SQL condition on the match ``m``, its digits ``d`` and
    its neighbours ``l`` and ``r``; ``needs`` is a string without which no text can match (a cheap
    gate). ``prior`` is the score of a confirmed match and ``context`` a regex of words nearby that
    add ``CONTEXT_BONUS`` to it. ``base`` spans stay whatever else is found; others give way to them.
    """

    kind: str
    pattern: str
    valid: str
    prior: float
    context: str
    needs: str = ""
    base: bool = False


CONTEXT_BONUS = 0.3

_ALONE = "NOT rlike(right(l, 1), '[A-Za-z0-9]') AND NOT rlike(left(r, 1), '[A-Za-z0-9]')"
#: Rearranged letters and digits of an IBAN are a number that is 1 modulo 97.
_MOD97 = """aggregate(split(concat(substr(c, 5), left(c, 4)), ''), 0, (a, x) ->
  CASE WHEN x = '' THEN a WHEN x <= '9' THEN (a * 10 + cast(x as int)) % 97 ELSE (a * 100 + ascii(x) - 55) % 97 END) = 1"""

RULES = (
    Rule(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "true", 0.9, "e-?mail|contact|write|kontakt|correo|courriel", "@", True,
    ),
    Rule(
        "ip",
        r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        r"rlike(m, '^(?:0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})(?:\\.|$)){4}$')",
        0.7, r"\bip\b|address|host|server|adresse", ".", True,
    ),
    Rule(
        "card",
        r"[0-9](?:[\x20-]?+[0-9])++",
        "length(d) BETWEEN 12 AND 19 AND luhn_check(d)",
        0.7, "card|visa|master|amex|karte|carte|tarjeta", "", True,
    ),
    Rule(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        "length(d) BETWEEN 9 AND 15",
        0.7, "call|phone|tel|mobil|fax|llam", "+", True,
    ),
    Rule(
        "iban",
        r"[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}+|(?:\x20[A-Z0-9]{4}){2,7}+(?:\x20[A-Z0-9]{1,3})?+)",
        f"{_ALONE} AND exists(array(replace(m, ' ', '')), c -> length(c) BETWEEN 15 AND 34 AND {_MOD97})",
        0.7, r"iban|bank|account|konto|compte|cuenta",
    ),
    Rule(
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        f"{_ALONE} AND NOT rlike(m, '^(?:000|666|9)|-00-|-0000$')",
        0.4, r"\bssn\b|social security|tax ?id", "-",
    ),
    Rule(
        "local_phone",
        r"\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}",
        _ALONE,
        0.4, "call|phone|tel|mobil|fax|llam",
    ),
)

_SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double,base:boolean>"


def _sql_string(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Elements in a block of a running sum.
BLOCK = 64


def _let(body: str, **values: str) -> str:
    """SQL: ``body`` with names for values, each of which is worked out once (the optimizer may put a column's expression wherever it is used, lambdas too)."""
    fields = ", ".join(f"'{n}', {v}" for n, v in values.items())
    return f"transform(array(named_struct({fields})), z -> {body})[0]"


def _scans(df: DataFrame, arrays: dict[str, str], merge: str) -> DataFrame:
    """For each ``arrays[name]``, an array<int> column without negatives, a column ``name``: what comes before each element.

    ``merge`` is SQL of two ints ``p`` and ``q`` (a sum, a maximum); what comes before the first is 0.
    """
    put = lambda p, q: _bind(_bind(merge, "p", p), "q", q)
    grown = lambda q: f"named_struct('s', {put('a.s', q)}, 'o', concat(a.o, array(a.s)))"
    start = "named_struct('s', 0, 'o', cast(array() as array<int>))"
    block = """CASE WHEN size({v}) = 0 THEN cast(array() as array<struct<s:int,o:array<int>>>) ELSE
      {found} END"""
    found = f"""transform(sequence(0, cast((size(z.v) - 1) div {BLOCK} as int)), k ->
        aggregate(sequence(k * {BLOCK}, least(k * {BLOCK} + {BLOCK}, size(z.v)) - 1), {start}, (a, i) -> {grown("z.v[i]")}))"""
    df = df.withColumns({f"{n}_blocks": F.expr(block.format(v=v, found=_let(found, v=v))) for n, v in arrays.items()})
    df = df.withColumns({f"{n}_sums": F.expr(f"aggregate({n}_blocks, {start}, (a, x) -> {grown('x.s')}, a -> a.o)") for n in arrays})
    shifted = f"flatten(transform(z.b, (x, k) -> transform(x.o, y -> {put('z.s[k]', 'y')})))"
    df = df.withColumns({n: F.expr(_let(shifted, b=f"{n}_blocks", s=f"{n}_sums")) for n in arrays})
    return df.drop(*[f"{n}_{x}" for n in arrays for x in ("blocks", "sums")])


def _spans_of(rule: Rule, rank: int, name: str) -> str:
    """SQL: the array of this rule's confirmed spans, in order, from its hits, the pieces between them and what comes before each."""
    score = f"{rule.prior}D + CASE WHEN rlike(lower(concat(right(l, {CONTEXT}), ' ', left(r, {CONTEXT}))), {_sql_string(rule.context)}) THEN {CONTEXT_BONUS}D ELSE 0.0D END"
    keep = "true" if rule.base else f"({score}) >= {THRESHOLD}D"
    span = f"named_struct('start', s, 'rank', {rank}, 'end', s + length(m), 'kind', '{rule.kind}', 'score', least(1.0D, {score}), 'base', {str(rule.base).lower()})"
    found = f"CASE WHEN {rule.valid} AND {keep} THEN {span} END"
    for short, value in (
        ("d", "regexp_replace(z.hits[i], '[^0-9]', '')"), ("m", "z.hits[i]"), ("l", "z.pieces[i]"), ("r", "z.pieces[i + 1]"),
        ("s", "z.before[i] + length(z.pieces[i])"),
    ):
        found = _bind(found, short, value)
    found = f"filter(transform(sequence(0, size(z.hits) - 1), i -> {found}), x -> x IS NOT NULL)"
    found = _let(found, hits=f"pii_hits_{name}", pieces=f"pii_pieces_{name}", before=f"pii_at_{name}")
    return f"CASE WHEN size(pii_hits_{name}) = 0 THEN cast(array() as array<{_SPAN}>) ELSE {found} END"


def _bind(sql: str, name: str, value: str) -> str:
    # Only bare names, not those inside quotes or after a dot.
    parts = re.split(r"('(?:[^'\\]|\\.)*')", sql)
    return "".join(x if x.startswith("'") else re.sub(rf"(?<![.\w]){name}(?![\w(])", value, x) for x in parts)


def find_pii(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with a column ``pii_spans``: array of (start, rank, end, kind, score, base), in order.

    Offsets are code points of the whole text, ``end`` exclusive; order is by start, then by the
    rules' order. Within one kind spans are leftmost and never overlap; matches that fail their
    checksum are dropped and not tried again from the inside. A span of a rule that is not ``base``
    is dropped where it overlaps a base span. Null and empty texts have no spans; equal rows get equal
    spans; an empty table gives an empty result. Columns of ``docs`` are kept as they are; names starting with ``pii_``
    are reserved. The cost is linear in text and matches.
    """
    out = docs.withColumn("pii_text", text_or_empty(text))
    names = range(len(rules))
    hits = {}
    for i, rule in enumerate(rules):
        found = F.regexp_extract_all("pii_text", F.lit(rule.pattern), F.lit(0))
        if rule.needs:
            found = F.when(F.contains("pii_text", F.lit(rule.needs)), found).otherwise(F.array().cast("array<string>"))
        hits[f"pii_hits_{i}"] = found
    out = out.withColumns(hits)
    none = F.array().cast("array<string>")
    out = out.withColumns({f"pii_pieces_{i}": F.when(F.size(f"pii_hits_{i}") > 0, F.split("pii_text", F.lit(rules[i].pattern), -1)).otherwise(none) for i in names})
    lengths = "transform(z.hits, (m, i) -> length(m) + length(z.pieces[i]))"
    out = out.withColumns({f"pii_lengths_{i}": F.expr(_let(lengths, hits=f"pii_hits_{i}", pieces=f"pii_pieces_{i}")) for i in names})
    out = _scans(out, {f"pii_at_{i}": f"pii_lengths_{i}" for i in names}, "p + q")
    spans = [F.expr(_spans_of(r, i, str(i))) for i, r in enumerate(rules)]
    out = out.withColumn("pii_all", F.sort_array(F.concat(F.array().cast(f"array<{_SPAN}>"), *spans)))
    # A span that is not a base one gives way to base spans that begin before it and end inside or after, or begin inside.
    some = "CASE WHEN exists(pii_all, x -> NOT x.base) THEN {} ELSE cast(array() as array<int>) END"
    out = out.withColumns({
        "pii_ends": F.expr(some.format("transform(pii_all, x -> CASE WHEN x.base THEN x.`end` ELSE 0 END)")),
        "pii_starts": F.expr(some.format("reverse(transform(pii_all, x -> CASE WHEN x.base THEN 2147483647 - x.start ELSE 0 END))")),
    })
    out = _scans(out, {"pii_reach": "pii_ends", "pii_next": "pii_starts"}, "greatest(p, q)")
    free = "filter(z.all, (x, i) -> x.base OR (z.reach[i] <= x.start AND 2147483647 - z.next[size(z.all) - 1 - i] >= x.`end`))"
    free = _let(free, all="pii_all", reach="pii_reach", next="pii_next")
    out = out.withColumn("pii_spans", F.expr(f"CASE WHEN size(pii_ends) = 0 THEN pii_all ELSE {free} END"))
    made = [f"pii_{x}_{i}" for x in ("hits", "pieces", "lengths", "at") for i in names]
    return out.drop("pii_text", "pii_all", "pii_ends", "pii_starts", "pii_reach", "pii_next", *made)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact_pii(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in angle brackets.

    Where spans overlap, the one that starts first is replaced and the others go with it; the text
    between is kept. ``n_chars`` follows the new text. Null texts stay null, empty ones and those without personal
    data as they are; equal rows stay equal, other columns untouched. An empty table gives an empty result.
    """
    found = find_pii(docs, rules).withColumn("pii_ends", F.expr("transform(pii_spans, x -> x.`end`)"))
    found = _scans(found, {"pii_reach": "pii_ends"}, "greatest(p, q)")
    # Four bytes a code point, so that pieces are cut out in constant time; the mark in front is for the decoder.
    found = found.withColumn("pii_wide", F.expr("CASE WHEN size(pii_spans) > 0 THEN encode(text, 'UTF-32') END"))
    cut = "decode(concat(X'0000FEFF', substring(z.wide, 4 * {0} + 1, 4 * ({1} - {0}))), 'UTF-32')"
    masked = f"""concat(array_join(transform(
        filter(sequence(0, size(z.spans) - 1), i -> z.spans[i].start >= z.reach[i]),
        i -> concat({cut.format("z.reach[i]", "z.spans[i].start")}, '<', upper(z.spans[i].kind), '>')), ''),
      {cut.format("z.last", "cast(octet_length(z.wide) div 4 as int)")})"""
    last = "greatest(element_at(pii_reach, -1), element_at(pii_ends, -1))"
    masked = F.expr(_let(masked, spans="pii_spans", reach="pii_reach", wide="pii_wide", last=last))
    found = found.withColumn("text", F.when(F.size("pii_spans") > 0, masked).otherwise(F.col("text")))
    found = found.drop("pii_spans", "pii_ends", "pii_reach", "pii_wide")
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def op1_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of ``documents``; odd rows as in ``find_pii``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_pii(docs).select("doc_id", "pii_spans")
    base = F.filter("pii_spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("pii_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in ("email", "ip", "card", "phone")],
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("pii_spans")).alias("spans"),
    )
