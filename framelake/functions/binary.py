"""Little-endian fields of binary columns, read and written in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def le_hex(c: Column, size: int) -> Column:
    """A whole number as `size` little-endian bytes, in hex; negative ones wrap around. The number is evaluated once."""
    big = F.lpad(F.hex(c.cast("long").bitwiseAND((1 << (8 * size)) - 1)), 2 * size, "0")
    return big if size == 1 else F.regexp_replace(big, "(..)" * size, "".join(f"${i}" for i in range(size, 0, -1)))


def unsigned(c: Column, offset: int, size: int) -> Column:
    """`size` little-endian bytes at `offset` (from 0) as BIGINT; null where the binary ends before."""
    h = F.hex(F.substring(c, offset + 1, size))
    big = h if size == 1 else F.regexp_replace(h, "^" + "(..)" * size + "$", "".join(f"${i}" for i in range(size, 0, -1)))
    return F.when(F.octet_length(c) >= offset + size, F.conv(big, 16, 10).cast("long"))


def u32(c: Column, offset: int) -> Column:
    return unsigned(c, offset, 4)


def i32(c: Column, offset: int) -> Column:
    """Signed 32 bits, by wrap-around."""
    v = unsigned(c, offset, 4)
    return F.when(v >= 2147483648, v - 4294967296).otherwise(v).cast("int")


def text(c: Column, offset: int, size: int) -> Column:
    return F.decode(F.substring(c, offset + 1, size), "ISO-8859-1")


def pack(*fields: tuple[Column, int]) -> Column:
    """Numbers as little-endian bytes of the given sizes, in hex; negative ones wrap around."""
    return F.concat(*(le_hex(v, n) for v, n in fields))


def bound(value: Column, use) -> Column:
    """`use(value)` with the value worked out once: a lambda that reads a computed column would work it out again for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)
