"""FNV-1a over UTF-16 units, exactly, as folds in 64-bit integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Offset bases and primes of FNV-1a.
BASE32, PRIME32 = 2166136261, 16777619
BASE64, PRIME64 = 14695981039346656037, 1099511628211


def units(s: Column) -> Column:
    """The UTF-16 units of a text, as integers."""
    four = F.regexp_extract_all(F.hex(F.encode(s, "UTF-16BE")), F.lit("[0-9A-F]{4}"), F.lit(0))
    return F.transform(four, lambda x: F.conv(x, 16, 10).cast("int"))


def _number32(s: Column) -> Column:
    step = lambda acc, u: F.pmod((acc.bitwiseXOR(u.cast("long"))) * PRIME32, F.lit(1 << 32))
    return F.aggregate(units(s), F.lit(BASE32).cast("long"), step)


def fnv32(s: Column) -> Column:
    return F.lower(F.lpad(F.hex(_number32(s)), 8, "0"))


def fnv32_base36(s: Column) -> Column:
    return F.lower(F.conv(_number32(s).cast("string"), 10, 36))


def fnv64(s: Column) -> Column:
    """16 hexadecimal digits.  The number is kept as its upper and lower 32 bits: the prime is 2**40 + 0x1B3."""
    m = (1 << 32) - 1

    def step(acc: Column, u: Column) -> Column:
        lo = acc["lo"].bitwiseXOR(u.cast("long"))
        low = lo * 0x1B3
        hi = acc["hi"] * 0x1B3 + F.shiftright(low, 32) + F.shiftleft(lo.bitwiseAND(F.lit((1 << 24) - 1)), 8)
        return F.struct(hi.bitwiseAND(F.lit(m)).alias("hi"), low.bitwiseAND(F.lit(m)).alias("lo"))

    start = F.struct(F.lit(BASE64 >> 32).cast("long").alias("hi"), F.lit(BASE64 & m).cast("long").alias("lo"))
    pad = lambda x: F.lpad(F.hex(x), 8, "0")
    return F.aggregate(units(s), start, step, lambda acc: F.lower(F.concat(pad(acc["hi"]), pad(acc["lo"]))))


def asset_line(asset_id: Column, path: Column, size: Column, digest: Column) -> Column:
    return F.concat_ws(":", asset_id, path, size.cast("string"), F.coalesce(F.nullif(digest, F.lit("")), F.lit("-")))


def asset_set(lines: Column) -> Column:
    return F.concat(F.lit("v1-"), fnv32(F.array_join(lines, "|")))
