"""Compatibility of units: each unit as powers of base units, computed from its text."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Powers of m, kg, s, K, mol, A of units that metadata use, the factor to base units, and other spellings.
UNITS = {
    "1": (0, 0, 0, 0, 0, 0, 1.0), "m": (1, 0, 0, 0, 0, 0, 1.0), "g": (0, 1, 0, 0, 0, 0, 1e-3), "s": (0, 0, 1, 0, 0, 0, 1.0), "min": (0, 0, 1, 0, 0, 0, 60.0), "h": (0, 0, 1, 0, 0, 0, 3600.0),
    "day": (0, 0, 1, 0, 0, 0, 86400.0), "month": (0, 0, 1, 0, 0, 0, 2629743.83), "year": (0, 0, 1, 0, 0, 0, 31556925.97), "K": (0, 0, 0, 1, 0, 0, 1.0), "degC": (0, 0, 0, 1, 0, 0, 1.0), "degF": (0, 0, 0, 1, 0, 0, 5 / 9),
    "mol": (0, 0, 0, 0, 1, 0, 1.0), "A": (0, 0, 0, 0, 0, 1, 1.0), "N": (1, 1, -2, 0, 0, 0, 1.0), "Pa": (-1, 1, -2, 0, 0, 0, 1.0), "bar": (-1, 1, -2, 0, 0, 0, 1e5), "atm": (-1, 1, -2, 0, 0, 0, 101325.0),
    "J": (2, 1, -2, 0, 0, 0, 1.0), "W": (2, 1, -3, 0, 0, 0, 1.0), "V": (2, 1, -3, 0, 0, -1, 1.0), "Hz": (0, 0, -1, 0, 0, 0, 1.0), "l": (3, 0, 0, 0, 0, 0, 1e-3), "Sv": (3, 0, -1, 0, 0, 0, 1e6),
    "degree": (0, 0, 0, 0, 0, 0, 0.017453292519943295), "radian": (0, 0, 0, 0, 0, 0, 1.0), "%": (0, 0, 0, 0, 0, 0, 0.01), "psu": (0, 0, 0, 0, 0, 0, 1e-3), "DU": (-2, 0, 0, 0, 1, 0, 4.4615e-4),
}
NAMED = {
    "m": "meter metre", "g": "gram", "s": "sec second", "min": "minute", "h": "hr hour", "day": "d", "month": "mon", "year": "yr a", "K": "kelvin degK degree_K", "degC": "celsius Celsius degree_C degreeC deg_C",
    "degF": "fahrenheit Fahrenheit degree_F degreeF", "mol": "mole", "A": "ampere", "N": "newton", "Pa": "pascal", "J": "joule", "W": "watt", "V": "volt", "Hz": "hertz", "l": "L liter litre", "Sv": "sverdrup Sverdrup",
    "degree": "deg degree_north degree_N degreeN degree_east degree_E degreeE degree_south degree_west degree_true", "radian": "rad", "%": "percent", "DU": "dobson", "bar": "Bar",
}
PREFIXES = {"T": 1e12, "G": 1e9, "M": 1e6, "k": 1e3, "h": 1e2, "d": 1e-1, "c": 1e-2, "m": 1e-3, "u": 1e-6, "n": 1e-9}
#: Units that stand with a prefix.
PREFIXED = ("m", "g", "s", "mol", "A", "N", "Pa", "bar", "J", "W", "V", "Hz", "l")
PLURALS = ("meter", "metre", "gram", "second", "sec", "minute", "hour", "hr", "day", "month", "year", "kelvin", "mole", "newton", "pascal", "joule", "watt", "volt", "liter", "litre", "degree", "radian")


def known_units() -> dict[str, tuple]:
    """Every spelling of every unit: its own, its names, these in the plural, and the units that take prefixes with each."""
    out = dict(UNITS)
    for unit, names in NAMED.items():
        for name in names.split():
            out[name] = UNITS[unit]
    for name in list(out):
        head, _, tail = name.partition("_")
        if head in PLURALS:
            out[f"{head}s_{tail}" if tail else f"{head}s"] = out[name]
        elif head in ("degreeN", "degreeE", "degreeC", "degreeF"):
            out["degrees" + head[6:]] = out[name]
    for unit in PREFIXED:
        for prefix, factor in PREFIXES.items():
            out.setdefault(prefix + unit, (*UNITS[unit][:6], UNITS[unit][6] * factor))
    return out


#: ``known_units`` as a text, which the optimizer folds into one literal map.
_TABLE = json.dumps(known_units())


def dimension(units: Column) -> Column:
    """(powers, factor) of a product of units with powers, such as ``W m-2``, ``kg/m2``, ``m s^-1`` or ``m 2`` (a power apart); null where a part is
    unknown. An empty text is 1; a number in front is a factor. Zero points of scales are left out: degC measures what K does."""
    table = F.from_json(F.lit(_TABLE), "map<string,array<double>>")
    joined = F.regexp_replace(F.trim(units), r"([A-Za-z%])\s+([+-]?[0-9]+)(?![0-9.])", "$1$2")
    marked = F.regexp_replace(joined, r"\s*/\s*", " /")
    parts = F.filter(F.split(F.when(marked == "", "1").otherwise(marked), r"[ .*]+(?=[^0-9])|\s+"), lambda x: x != "")
    over = lambda x: F.when(F.startswith(x, F.lit("/")), -1.0).otherwise(1.0)
    symbol = lambda x: F.regexp_extract(x, r"^/?([A-Za-z_%]+|1$)", 1)
    power = lambda x: over(x) * F.coalesce(F.regexp_extract(x, r"^/?[A-Za-z_%]+\^?([+-]?[0-9]+)$", 1).try_cast("double"), F.lit(1.0))
    number = lambda x: F.regexp_extract(x, r"^/?([0-9.]+(?:[eE][+-]?[0-9]+)?)$", 1).try_cast("double")
    read = F.transform(parts, lambda x: F.struct(number(x).alias("number"), over(x).alias("over"), power(x).alias("power"), F.try_element_at(table, symbol(x)).alias("unit")))
    known = F.transform(
        read,
        lambda r: F.struct(
            F.when(r["number"].isNotNull(), F.array(*[F.lit(0.0)] * 6)).otherwise(F.transform(F.slice(r["unit"], 1, 6), lambda p: p * r["power"])).alias("powers"),
            F.when(r["number"].isNotNull(), F.pow(r["number"], r["over"])).otherwise(F.pow(F.try_element_at(r["unit"], F.lit(7)), r["power"])).alias("factor"),
        ),
    )
    one = F.struct(F.array(*[F.lit(0.0)] * 6).alias("powers"), F.lit(1.0).alias("factor"))
    # null as soon as a part is unknown
    product = lambda a, r: F.when(a.isNotNull() & r["powers"].isNotNull(), F.struct(F.zip_with(a["powers"], r["powers"], lambda u, v: u + v).alias("powers"), (a["factor"] * r["factor"]).alias("factor")))
    return F.aggregate(known, one, product)


def compatible(a: Column, b: Column) -> Column:
    """Whether two units measure the same; null where one is unknown."""
    return dimension(a)["powers"] == dimension(b)["powers"]
