"""Checksums and bit fields of text and bytes as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Generators of CRC-24Q and of the reflected CRC-32 (fixed values).
CRC24Q, CRC32 = 0x1864CFB, 0xEDB88320


def octets(data: Column) -> Column:
    """Array of a binary column's bytes, 0 to 255. The data are read once, not again for each byte, as they may be a long expression."""
    return F.transform(F.regexp_extract_all(F.hex(data), F.lit("(..)"), 1), lambda b: F.conv(b, 16, 10).cast("long"))


def crc24q(data: Column) -> Column:
    def byte(crc: Column, b: Column) -> Column:
        crc = crc.bitwiseXOR(F.shiftleft(b, 16))
        bit = lambda c, _: F.when(F.shiftleft(c, 1).bitwiseAND(F.lit(1 << 24)) != 0, F.shiftleft(c, 1).bitwiseXOR(F.lit(CRC24Q))).otherwise(F.shiftleft(c, 1))
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), crc, bit)

    return F.aggregate(octets(data), F.lit(0).cast("long"), byte)


def crc32_plain(data: Column) -> Column:
    """Reflected CRC-32 that starts at 0 and isn't inverted at the end (so not that of zip files)."""

    def byte(crc: Column, b: Column) -> Column:
        crc = crc.bitwiseXOR(b)
        bit = lambda c, _: F.when(c.bitwiseAND(F.lit(1)) == 1, F.shiftright(c, 1).bitwiseXOR(F.lit(CRC32))).otherwise(F.shiftright(c, 1))
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), crc, bit)

    return F.aggregate(octets(data), F.lit(0).cast("long"), byte)


def xor_checksum(text: Column) -> Column:
    """Two upper-case hex digits: exclusive or of all bytes, as sentences of receivers end with."""
    x = F.aggregate(octets(F.encode(text, "utf-8")), F.lit(0).cast("long"), lambda a, b: a.bitwiseXOR(b))
    return F.lpad(F.hex(x), 2, "0")


def unsigned(data: Column, at: int, n: int) -> Column:
    """n bits (63 at most) from bit `at`, most significant first."""
    first, last = at // 8, (at + n - 1) // 8
    whole = F.conv(F.hex(F.substring(data, first + 1, last - first + 1)), 16, 10).cast("decimal(20,0)")
    down = (last + 1) * 8 - at - n
    return (F.floor(whole / (1 << down)) % (1 << n)).cast("long") if last - first >= 7 else F.shiftright(whole.cast("long"), down).bitwiseAND(F.lit((1 << n) - 1))


def signed(data: Column, at: int, n: int) -> Column:
    v = unsigned(data, at, n)
    return F.when(v >= 1 << (n - 1), v - (1 << n)).otherwise(v)


def sign_magnitude(data: Column, at: int, n: int) -> Column:
    v = unsigned(data, at + 1, n - 1)
    return F.when(unsigned(data, at, 1) == 1, -v).otherwise(v)
