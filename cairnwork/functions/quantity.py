"""Quantities, intervals, money and exact fractions as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: SI prefixes as powers of ten.
PREFIXES = {"": 0, "T": 12, "G": 9, "M": 6, "k": 3, "h": 2, "d": -1, "c": -2, "m": -3, "u": -6, "µ": -6, "n": -9, "p": -12}
#: Units that take prefixes, as exponents of (m, kg, s, A, K, mol, cd, rad) and the factor to SI.
BASE_UNITS = {
    "m": ((1, 0, 0, 0, 0, 0, 0, 0), 1.0), "g": ((0, 1, 0, 0, 0, 0, 0, 0), 1e-3), "s": ((0, 0, 1, 0, 0, 0, 0, 0), 1.0), "A": ((0, 0, 0, 1, 0, 0, 0, 0), 1.0),
    "K": ((0, 0, 0, 0, 1, 0, 0, 0), 1.0), "mol": ((0, 0, 0, 0, 0, 1, 0, 0), 1.0), "cd": ((0, 0, 0, 0, 0, 0, 1, 0), 1.0), "rad": ((0, 0, 0, 0, 0, 0, 0, 1), 1.0),
    "Hz": ((0, 0, -1, 0, 0, 0, 0, 0), 1.0), "N": ((1, 1, -2, 0, 0, 0, 0, 0), 1.0), "Pa": ((-1, 1, -2, 0, 0, 0, 0, 0), 1.0), "J": ((2, 1, -2, 0, 0, 0, 0, 0), 1.0),
    "W": ((2, 1, -3, 0, 0, 0, 0, 0), 1.0), "V": ((2, 1, -3, -1, 0, 0, 0, 0), 1.0), "C": ((0, 0, 1, 1, 0, 0, 0, 0), 1.0), "L": ((3, 0, 0, 0, 0, 0, 0, 0), 1e-3),
}
#: Units without prefixes.
PLAIN_UNITS = {"min": ((0, 0, 1, 0, 0, 0, 0, 0), 60.0), "h": ((0, 0, 1, 0, 0, 0, 0, 0), 3600.0), "deg": ((0, 0, 0, 0, 0, 0, 0, 1), 3.141592653589793 / 180), "rpm": ((0, 0, -1, 0, 0, 0, 0, 1), 3.141592653589793 / 30), "%": ((0,) * 8, 0.01)}


def units() -> dict[str, tuple[tuple[int, ...], float]]:
    """All units with all prefixes, made by the rule."""
    table = {p + u: (dims, factor * 10.0**e) for p, e in PREFIXES.items() for u, (dims, factor) in BASE_UNITS.items()}
    return table | PLAIN_UNITS | {"": ((0,) * 8, 1.0)}


_NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
_QUANTITY = rf"^\s*({_NUMBER})\s*(\S*)\s*$"


def _unit_map(of: int) -> Column:
    pick = (lambda v: v[1]) if of else (lambda v: ",".join(map(str, v[0])))
    return F.create_map(*chain.from_iterable((F.lit(k), F.lit(pick(v))) for k, v in sorted(units().items())))


def unit_terms(unit: Column) -> Column:
    """The factors of a unit such as N*m, m/s^2 or kg*m^2: (symbol, exponent); after a slash exponents are
    negative."""
    parts = F.regexp_extract_all(unit, F.lit(r"(?:^|[*/·])[^*/·]+"), F.lit(0))
    return F.transform(parts, lambda p: F.struct(F.regexp_replace(p, r"^[*/·]|\^-?\d+$", "").alias("u"), (F.coalesce(F.nullif(F.regexp_extract(p, r"\^(-?\d+)$", 1), F.lit("")).try_cast("int"), F.lit(1)) * F.when(p.startswith("/"), -1).otherwise(1)).alias("e")))


def parse_quantity(text: Column) -> Column:
    """Struct (value in SI units, dimension as text of eight exponents) of a number with an optional unit; null
    when the text is none, or a unit is not known."""
    number, unit = F.regexp_extract(text, _QUANTITY, 1).try_cast("double"), F.regexp_extract(text, _QUANTITY, 2)
    factors, dims = _unit_map(1), _unit_map(0)
    terms = F.filter(unit_terms(unit), lambda t: t["u"] != "")
    scale = F.aggregate(terms, F.lit(1.0), lambda a, t: a * F.pow(F.try_element_at(factors, t["u"]), t["e"].cast("double")))
    zero = F.array(*(F.lit(0) for _ in range(8)))
    dimension = F.aggregate(terms, zero, lambda a, t: F.zip_with(a, F.transform(F.split(F.try_element_at(dims, t["u"]), ","), lambda x: x.cast("int") * t["e"]), lambda x, y: x + y))
    good = number.isNotNull() & scale.isNotNull()
    return F.when(good, F.struct((number * scale).alias("value"), F.array_join(dimension, ",").alias("dimension")))


def comparable(text: Column) -> Column:
    """The quantity of a text when it is shaped like one."""
    return parse_quantity(text)


def add_quantities(a: Column, b: Column) -> Column:
    """Sum of two quantities of one dimension; null when the dimensions differ."""
    return F.when(a["dimension"] == b["dimension"], F.struct((a["value"] + b["value"]).alias("value"), a["dimension"].alias("dimension")))


def multiply_quantities(a: Column, b: Column, sign: int = 1) -> Column:
    """Product (or quotient with sign -1) of two quantities; null on a division by zero."""
    dims = F.zip_with(F.split(a["dimension"], ","), F.split(b["dimension"], ","), lambda x, y: x.cast("int") + y.cast("int") * sign)
    value = a["value"] * b["value"] if sign > 0 else F.try_divide(a["value"], b["value"])
    return F.when(value.isNotNull(), F.struct(value.alias("value"), F.array_join(dims, ",").alias("dimension")))


# ---- intervals: structs of low and high

def interval(low: Column, high: Column) -> Column:
    """Null when an end is missing or they are the wrong way round."""
    return F.when(low <= high, F.struct(low.alias("low"), high.alias("high")))


def parse_interval(text: Column) -> Column:
    """`low..high` or one number."""
    low = F.regexp_extract(text, rf"^\s*({_NUMBER})", 1).try_cast("double")
    high = F.coalesce(F.nullif(F.regexp_extract(text, rf"\.\.\s*({_NUMBER})", 1), F.lit("")).try_cast("double"), low)
    return interval(low, high)


def parse_money(text: Column) -> Column:
    """`low..high CUR[/unit]`: struct (low, high, currency, per_unit)."""
    i = parse_interval(text)
    currency = F.nullif(F.regexp_extract(text, r"\b([A-Z]{3})\b", 1), F.lit(""))
    return F.when(i.isNotNull() & currency.isNotNull(), F.struct(i["low"].alias("low"), i["high"].alias("high"), currency.alias("currency"), F.nullif(F.regexp_extract(text, r"/\s*(\w+)\s*$", 1), F.lit("")).alias("per_unit")))


def interval_add(a: Column, b: Column) -> Column:
    return interval(a["low"] + b["low"], a["high"] + b["high"])


def interval_subtract(a: Column, b: Column) -> Column:
    return interval(a["low"] - b["high"], a["high"] - b["low"])


def interval_multiply(a: Column, b: Column) -> Column:
    ends = [a[x] * b[y] for x in ("low", "high") for y in ("low", "high")]
    return interval(F.least(*ends), F.greatest(*ends))


def interval_hull(a: Column, b: Column) -> Column:
    return interval(F.least(a["low"], b["low"]), F.greatest(a["high"], b["high"]))


def locate(a: Column, x: Column) -> Column:
    return F.when(x < a["low"], "below").when(x > a["high"], "above").when(x.isNotNull() & a.isNotNull(), "inside")


# ---- exact fractions: structs of num and den (decimal(38,0), den > 0, in lowest terms)

def rational(num: Column, den: Column) -> Column:
    """In lowest terms; null on a zero denominator or an overflow. Euclid's steps are unrolled by an aggregate
    over a fixed range, which no pair of 38-digit numbers outlasts."""
    big = "decimal(38,0)"
    n, d = num.try_cast(big), den.try_cast(big)
    pair = F.struct(F.abs(n).alias("a"), F.abs(d).alias("b"))
    step = F.aggregate(F.sequence(F.lit(1), F.lit(190)), pair, lambda s, _: F.when(s["b"] == 0, s).otherwise(F.struct(s["b"].alias("a"), (s["a"] % F.when(s["b"] != 0, s["b"])).cast(big).alias("b"))))
    g = F.when(step["a"] == 0, F.lit(1).cast(big)).otherwise(step["a"])
    sign = F.when(d < 0, F.lit(-1)).otherwise(F.lit(1))
    div = lambda x: F.try_divide(x, g).try_cast(big)
    return F.when((d != 0) & n.isNotNull(), F.struct((div(n) * sign).try_cast(big).alias("num"), F.abs(div(d)).try_cast(big).alias("den")))


def rational_add(a: Column, b: Column) -> Column:
    return rational(F.try_add(F.try_multiply(a["num"], b["den"]), F.try_multiply(b["num"], a["den"])), F.try_multiply(a["den"], b["den"]))


def rational_multiply(a: Column, b: Column) -> Column:
    return rational(F.try_multiply(a["num"], b["num"]), F.try_multiply(a["den"], b["den"]))


def rational_negate(a: Column) -> Column:
    return F.when(a.isNotNull(), F.struct((-a["num"]).alias("num"), a["den"].alias("den")))


def rational_compare(a: Column, b: Column) -> Column:
    """-1, 0 or 1 as a is less than, equal to or greater than b; null where either is, or the products overflow."""
    return F.signum(F.try_subtract(F.try_multiply(a["num"], b["den"]), F.try_multiply(b["num"], a["den"]))).cast("int")


def nearest_fraction(x: Column, most: int) -> Column:
    """The fraction nearest to a number among those whose denominator is at most `most`; of equally near ones that with
    the least denominator. Null for null, NaN and infinity."""
    tried = F.transform(F.sequence(F.lit(1), F.lit(most)), lambda q: F.struct(F.abs(x - F.round(x * q) / q).alias("off"), q.alias("den"), F.round(x * q).cast("long").alias("num")))
    best = F.array_min(tried)
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(9e15)), F.struct(best["num"].alias("num"), best["den"].alias("den")))


def element_count(shape: Column) -> Column:
    """Product of a tensor's shape; 1 for a scalar."""
    return F.aggregate(shape, F.lit(1).cast("long"), lambda a, x: a * x)


def common_currency(currencies: Sequence[Column]) -> Column:
    first = currencies[0]
    same = F.lit(True)
    for c in currencies[1:]:
        same = same & (c == first)
    return F.when(same, first)
