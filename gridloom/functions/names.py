"""Names of designs, scenarios and modules in comparable form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of Unicode property White_Space.
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trimmed(col: Column | str) -> Column:
    """Text without white space of any kind at its ends; null stays null. The search for all kinds is slow, so that
    it is made only where the first or last character is not printable ASCII."""
    col = F.col(col) if isinstance(col, str) else col
    plain = F.ascii(col).between(33, 126) & F.ascii(F.substring(col, -1, 1)).between(33, 126)
    return F.when(plain, col).otherwise(F.trim(col, F.lit(WHITE)))


def clean_name(col: Column | str) -> Column:
    """A name trimmed and in lower case; null stays null."""
    return F.lower(trimmed(col))
