"""The bits of floating-point numbers and checksums over their bytes, as column arithmetic.

A double is taken apart with exact powers of two, so no function of another language is needed. A byte sum's state (a, b, n) merges:
parts of a record are summed apart and joined in order.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ONE = 1 << 52
#: Modulus of the sums: folding the upper half of a 32-bit sum into the lower is arithmetic modulo it, with 65535 in place of 0.
MODULUS = 65535


def _let(value: Column, use) -> Column:
    return F.transform(F.array(value), use)[0]


def double_bits(value: Column) -> Column:
    """The 64 bits of a double as a long: sign, exponent, mantissa; any not-a-number has the bits of the common one; null gives null."""
    v = value.cast("double")
    size = F.abs(v)
    # the exponent by logarithm may be one off beside a power of two
    near = F.greatest(F.floor(F.log2(size)), F.lit(-1023)).cast("int")

    def finite(e):
        e = F.when(F.pow(F.lit(2.0), e) > size, e - 1).when(F.pow(F.lit(2.0), e + 1) <= size, e + 1).otherwise(e)
        return _let(e, lambda x: F.when(x < -1022, _small(size)).otherwise((x + 1023).cast("long") * F.lit(_ONE) + ((size / F.pow(F.lit(2.0), x) - 1) * F.lit(float(_ONE))).cast("long")))

    inf = F.lit(2047).cast("long") * F.lit(_ONE)
    whole = F.when(size == 0, F.lit(0).cast("long")).when(size == float("inf"), inf).otherwise(_let(near, finite))
    negative = (v < 0) | ((v == 0) & F.startswith(v.cast("string"), F.lit("-")))
    signed = F.when(negative, whole.bitwiseOR(F.lit(-(1 << 63)))).otherwise(whole)
    return F.when(F.isnan(v), inf + F.lit(_ONE >> 1)).otherwise(F.when(v.isNotNull(), signed))


def _small(size: Column) -> Column:
    """The bits of a number below the normal ones: multiples of the least one, scaled in two exact steps."""
    return (size * F.lit(2.0**1000) * F.lit(2.0**74)).cast("long")


def from_double_bits(bits: Column) -> Column:
    """The double that has these bits; null gives null."""
    mantissa = bits.bitwiseAND(F.lit(_ONE - 1)).cast("double")
    e = F.shiftright(bits, 52).bitwiseAND(F.lit(2047)).cast("int")
    size = F.when(e == 0, mantissa * F.pow(F.lit(2.0), F.lit(-1074.0))).when(e == 2047, F.when(mantissa == 0, float("inf")).otherwise(float("nan"))).otherwise((1 + mantissa / F.lit(float(_ONE))) * F.pow(F.lit(2.0), e - 1023))
    return F.when(bits < 0, -size).otherwise(size)


def clear_low_double_bits(value: Column, n: int) -> Column:
    """A double with its ``n`` lowest bits 0, so that records that differ in noise only are equal; null stays null."""
    if not 0 <= n < 52:
        raise ValueError("0 to 51 bits of a double can be cleared")
    return from_double_bits(F.shiftleft(F.shiftright(double_bits(value), n), n))


def _state(a: Column, b: Column, n: Column) -> Column:
    return F.struct((a % MODULUS).cast("long").alias("a"), (b % MODULUS).cast("long").alias("b"), n.cast("long").alias("n"))


def joined(first: Column, second: Column) -> Column:
    """The state (a, b, n) of two parts, one behind the other: every byte of the first counts once more for each of the second."""
    return _state(first["a"] + second["a"], first["b"] + (second["n"] % MODULUS) * first["a"] + second["b"], first["n"] + second["n"])


def byte_state(values: Column, clear_bits: int = 0) -> Column:
    """struct<a, b, n>: the sum of the bytes of an array of doubles (the most significant first), the sum of these sums, and how many bytes.

    Null elements are taken as not-a-number, so that a gap is seen; a null array gives null, an empty one the state of nothing.
    """
    nothing = _state(F.lit(0), F.lit(0), F.lit(0))

    def own(v):
        known = F.coalesce(v.cast("double"), F.lit(float("nan")))
        bits = double_bits(clear_low_double_bits(known, clear_bits) if clear_bits else known)
        return _let(bits, lambda x: _state(_sum(x, lambda k: 1), _sum(x, lambda k: 8 - k), F.lit(8)))

    return F.aggregate(F.transform(values, own), nothing, joined)


def _sum(bits: Column, weight) -> Column:
    out = F.lit(0).cast("long")
    for k in range(8):
        out = out + F.shiftrightunsigned(bits, 56 - 8 * k).bitwiseAND(F.lit(255)) * weight(k)
    return out


def fletcher(state: Column) -> Column:
    """The 32-bit checksum of a state: both sums start at 65535, so that neither is ever 0."""
    half = lambda x: F.when(x % MODULUS == 0, F.lit(MODULUS)).otherwise(x % MODULUS)
    return half(state["b"]) * F.lit(65536).cast("long") + half(state["a"])
