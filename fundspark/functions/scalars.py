"""Scalar functions as Column expressions."""

from __future__ import annotations

import ast

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{M}\p{N}_]+"


def stripped(t: Column) -> Column:
    """Without blanks of any kind at the ends."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def to_decimal(t: Column) -> Column:
    """A rate: '2%', '2', '0.02', '2,5 %' -> fraction; a magnitude of 1 or more is a percentage; words and blanks give null."""
    s = F.replace(stripped(t), F.lit(","), F.lit("."))
    pct = F.endswith(s, F.lit("%"))
    v = F.when(pct, stripped(F.rtrim(s, F.lit("%"))).try_cast("double")).otherwise(s.try_cast("double"))
    return F.when(pct | (F.abs(v) >= 1), v / 100).otherwise(v)


def to_amount(t: Column) -> Column:
    """An amount: signs other than digits, marks and minus are dropped; a lone comma is a decimal mark before at most two digits, else it groups."""
    c = F.regexp_replace(t, r"[^\d.,-]", "")
    comma, dot = F.contains(c, F.lit(",")), F.contains(c, F.lit("."))
    short = F.length(F.substring_index(c, ",", -1)) <= 2
    return F.when(comma & ~dot & short, F.replace(c, F.lit(","), F.lit("."))).otherwise(F.replace(c, F.lit(","), F.lit(""))).try_cast("double")


def parse_day(t: Column) -> Column:
    return F.coalesce(F.try_to_date(stripped(t), "d/M/yyyy"), F.try_to_date(stripped(t), "yyyy-M-d"))


def first_percent(t: Column) -> Column:
    v = F.regexp_extract(t, r"(-?\d+(?:[.,]\d+)?)\s*%", 1)
    return F.when(v != "", F.replace(v, F.lit(","), F.lit(".")).try_cast("double") / 100)


def isin_valid(t: Column) -> Column:
    """Format and check digit (letters count as 10 to 35, Luhn over all digits)."""
    spelled = F.array_join(F.transform(F.split(t, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), "")
    ok = t.rlike("^[A-Z]{2}[0-9A-Z]{9}[0-9]$")
    return F.when(ok, F.call_function("luhn_check", spelled)).otherwise(F.when(t.isNotNull(), F.lit(False)))


def tokens(t: Column) -> Column:
    """Lower-case words in Unicode letters, marks, digits and underscores."""
    return F.transform(F.regexp_extract_all(t, F.lit(f"({WORD})"), F.lit(1)), F.lower)


def numbers_in(t: Column) -> Column:
    """Numbers of a text as doubles; whole numbers below 10 (list and scale marks) are left out."""
    raw = F.regexp_extract_all(t, F.lit(r"(\d[\d\s\x{a0}\x{202f}]*(?:[.,]\d+)?)"), F.lit(1))
    v = F.transform(raw, lambda x: F.replace(F.regexp_replace(x, r"[\s\x{a0}\x{202f}]", ""), F.lit(","), F.lit(".")).try_cast("double"))
    return F.filter(v, lambda x: x.isNotNull() & ~((F.abs(x) < 10) & (x == F.floor(x))))


def preview(t: Column, most: int = 500) -> Column:
    flat = F.regexp_replace(t, "\n", " ")
    return F.when(F.length(flat) <= most, flat).otherwise(F.concat(F.left(flat, F.lit(most)), F.lit("… (+"), (F.length(flat) - most).cast("string"), F.lit(")")))


def chunk_id(source: Column, kind: str, *parts: Column) -> Column:
    """First 16 hex digits of the SHA-1 of source and position."""
    return F.substring(F.sha1(F.concat_ws("::", source, F.lit(kind), *[p.cast("string") for p in parts])), 1, 16)


def hex_id(t: Column) -> Column:
    """A hex id as a decimal string (unsigned 64 bits); other ids by a stable hash."""
    return F.when(t.rlike("^[0-9a-fA-F]{1,16}$"), F.conv(t, 16, 10)).otherwise(F.abs(F.xxhash64(t)).cast("string"))


_ACCENTED = "àâäáãåçéèêëíìîïñóòôöõúùûüýÿÀÂÄÁÃÅÇÉÈÊËÍÌÎÏÑÓÒÔÖÕÚÙÛÜÝ"
_PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"


def plain_lower(t: Column) -> Column:
    """Lower case without accents, combining ones too."""
    return F.lower(F.translate(F.regexp_replace(t, r"\p{Mn}", ""), _ACCENTED, _PLAIN))


def all_matches(t: Column, patterns: tuple[str, ...]) -> Column:
    """First groups of every match of all patterns, pattern by pattern."""
    return F.flatten(F.array(*[F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in patterns]))


def signed_percent(x: Column, decimals: int = 2) -> Column:
    """0.0512 as +5.12%."""
    return F.format_string(f"%+.{decimals}f%%", x * 100)


def spaced(x: Column, decimals: int = 0) -> Column:
    """A number with blanks between thousands."""
    return F.translate(F.format_number(x, decimals), ",", " ")


def arithmetic(expression: str) -> Column:
    """A Column of an arithmetic expression: numbers, + - * / % and signs, at most 200 characters; the sign of % follows the divisor."""
    if len(expression) > 200:
        raise ValueError("expression too long")

    def build(n: ast.AST) -> Column:
        if isinstance(n, ast.Expression):
            return build(n.body)
        if isinstance(n, ast.Constant) and isinstance(n.value, (int, float)) and not isinstance(n.value, bool):
            return F.lit(float(n.value))
        if isinstance(n, ast.UnaryOp) and isinstance(n.op, (ast.UAdd, ast.USub)):
            return build(n.operand) * (1 if isinstance(n.op, ast.UAdd) else -1)
        if isinstance(n, ast.BinOp):
            a, b = build(n.left), build(n.right)
            if isinstance(n.op, ast.Add):
                return a + b
            if isinstance(n.op, ast.Sub):
                return a - b
            if isinstance(n.op, ast.Mult):
                return a * b
            if isinstance(n.op, ast.Div):
                return F.try_divide(a, b)
            if isinstance(n.op, ast.Mod):
                return a - F.floor(F.try_divide(a, b)) * b
        raise ValueError("only numbers, + - * / % and signs are allowed")

    return build(ast.parse(expression.strip(), mode="eval"))
