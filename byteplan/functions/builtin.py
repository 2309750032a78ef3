"""Expressions made of Spark's own functions; everything here stays in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..kernels import profile


def first_bytes(content: Column, n: int = profile.MAGIC_LENGTH) -> Column:
    return F.substring(content, 1, n)


def apply_magic(content: Column) -> Column:
    """Whether a blob begins like a compressed format; only its first bytes are looked at."""
    head = F.hex(first_bytes(content))
    plain = reduce(Column.__or__, [F.startswith(head, F.lit(m)) for m in profile.MAGIC])
    full = F.length(head) == 2 * profile.MAGIC_LENGTH
    placed = [
        full & F.startswith(head, F.lit(a)) & (F.substring(head, 2 * at + 1, len(b)) == b) for a, b, at in profile.MAGIC_AT
    ]
    return F.coalesce(reduce(Column.__or__, [plain, *placed]), F.lit(False))


def looks_json(text: Column) -> Column:
    """Whether the first byte that is not white space opens an object, or an array of objects at once."""
    return F.coalesce(F.rlike(text, F.lit(r"^[ \t\r\n]*(\{|\[\{)")), F.lit(False))


def leb_size(n: Column) -> Column:
    """Bytes of an unsigned 32-bit number."""
    out = F.lit(5)
    for k in (4, 3, 2, 1):
        out = F.when(n < 1 << 7 * k, k).otherwise(out)
    return out


def leb_encode(n: Column) -> Column:
    """The number's bytes as upper-case hexadecimal."""
    parts = []
    for k in range(5):
        group = F.shiftright(n, 7 * k).bitwiseAND(0x7F)
        more = F.when(leb_size(n) > k + 1, 128).otherwise(0)
        parts.append(F.when(leb_size(n) > k, F.lpad(F.hex(group + more), 2, "0")).otherwise(""))
    return F.concat(*parts)


def loop_gain(length: Column, period: Column, count: Column) -> Column:
    """Bytes saved by a loop in place of a literal."""
    body = 1 + leb_size(period) + period
    return (1 + leb_size(length) + length) - (1 + leb_size(count) + leb_size(body) + body)


def macro_gain(length: Column, uses: Column, macro: Column) -> Column:
    """Bytes saved by a macro used so often in place of its literals."""
    literal = 1 + leb_size(length) + length
    return uses * (literal - 1 - leb_size(macro)) - 4 - literal


def smallest_period(text: str) -> Column:
    """Smallest period of at least 4 that the whole text repeats at least 3 times; null if there is none."""
    return F.expr(
        f"""get(filter(sequence(4, greatest(4, length({text}) div 3)), p ->
              p <= length({text}) div 3 AND length({text}) % p = 0 AND
              repeat(left({text}, p), length({text}) div p) = {text}), 0)"""
    )


def count_delimiters(line: Column, delimiter: str) -> Column:
    """Delimiters outside double quotes (an unfinished quote reaches to the end)."""
    bare = F.regexp_replace(line, r'"[^"]*("|$)', "")
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit("")))


def line_array(text: Column) -> Column:
    return F.split(text, "\n", -1)


def mean_line_similarity(text: str) -> Column:
    """Mean Jaccard similarity of the 4-gram sets of neighbouring lines of at least 4 characters; 0 for under two.

    On ASCII text this is the byte measure. One row stays one row: no explode, no shuffle.
    """
    return F.expr(
        f"""transform(array(transform(filter(split({text}, '\\n', -1), l -> length(l) >= 4), l ->
              array_distinct(transform(sequence(1, length(l) - 3), i -> substring(l, i, 4))))), g ->
            CASE WHEN size(g) < 2 THEN 0.0D ELSE aggregate(sequence(1, size(g) - 1), 0.0D, (s, i) ->
              s + size(array_intersect(g[i - 1], g[i])) / size(array_union(g[i - 1], g[i]))) / (size(g) - 1) END)[0]"""
    )


def redundancy(length: Column, entropy: Column) -> Column:
    """Bytes of a blob that its byte frequencies make superfluous."""
    return length * (1 - entropy / 8)


def human_size(n: Column) -> Column:
    """1,536 -> 1.5 KB; a tenth that lies halfway goes to the even one."""
    out = F.format_string("%d B", n)
    for k, unit in enumerate(("KB", "MB", "GB"), 1):
        out = F.when(n >= 1 << 10 * k, F.format_string(f"%.1f {unit}", F.bround(n / (1 << 10 * k), 1))).otherwise(out)
    return out
