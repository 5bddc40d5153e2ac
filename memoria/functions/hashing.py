"""64-bit fingerprints as column expressions: FNV-1a, SimHash and Hamming distance."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The public FNV-1a parameters, offset basis and prime, in 32-bit halves.
OFFSET_HIGH, OFFSET_LOW = 0xCBF29CE4, 0x84222325
PRIME_LOW = 0x1B3  # the prime is 2^40 + 0x1B3


def fnv1a(text: Column) -> Column:
    """Signed 64-bit FNV-1a of the UTF-8 bytes. Halves of 32 bits keep every step inside a long, so ANSI mode never overflows."""
    return bound(F.decode(F.encode(text, "UTF-8"), "ISO-8859-1"), _fnv1a_latin)


def bound(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` applied to a value that is computed once for each row, however often it is used."""
    return F.transform(F.array(value), make)[0]


def _fnv1a_latin(latin: Column) -> Column:
    """The hash of a text with one character for each byte."""
    def step(state: Column, i: Column) -> Column:
        low = state["low"].bitwiseXOR(F.ascii(F.substring(latin, i, F.lit(1))).cast("long"))
        product = low * PRIME_LOW
        high = state["high"] * PRIME_LOW + low * 256 + F.shiftright(product, 32)
        return F.struct(high.bitwiseAND(F.lit(0xFFFFFFFF)).alias("high"), product.bitwiseAND(F.lit(0xFFFFFFFF)).alias("low"))

    start = F.struct(F.lit(OFFSET_HIGH).cast("long").alias("high"), F.lit(OFFSET_LOW).cast("long").alias("low"))
    size = F.length(latin)
    steps = F.when(size > 0, F.sequence(F.lit(1), size)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, start, step, lambda s: F.shiftleft(s["high"], 32).bitwiseOR(s["low"]))


def simhash(hashes: Column, bits: int = 64) -> Column:
    """Fingerprint of an array of 64-bit hashes: a bit is set where at least half of the hashes have it. No hashes give 0."""
    votes = lambda bit: F.aggregate(hashes, F.lit(0), lambda n, h: n + F.when(F.getbit(h, bit) == 1, 1).otherwise(-1))
    word = F.aggregate(F.sequence(F.lit(0), F.lit(bits - 1)), F.lit(0).cast("long"), lambda w, bit: F.when(votes(bit) >= 0, w.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))).otherwise(w))
    return F.when(F.size(hashes) > 0, word).otherwise(F.lit(0).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def bands(fingerprint: Column, distance: int) -> Column:
    """Array of (band, bits): two 64-bit values within ``distance`` agree in at least one of distance + 1 bands."""
    n = distance + 1
    cuts = [64 * k // n for k in range(n + 1)]
    parts = [
        F.struct(F.lit(k).alias("band"), F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)).alias("bits"))
        for k, (a, b) in enumerate(zip(cuts, cuts[1:]))
    ]
    return F.array(*parts)
