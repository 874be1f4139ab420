"""Numbers in texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import SPACE, normalize


def parse_amount(value: Column) -> Column:
    """A text with thousands separators as a double; null where it is no finite number. 0x, 0o and 0b prefixes count."""
    plain = F.regexp_replace(normalize(value), f"[,{SPACE}]+", "")
    found = F.when(plain.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), plain.try_cast("double"))
    for prefix, digits, base in (("xX", "0-9a-fA-F", 16), ("oO", "0-7", 8), ("bB", "01", 2)):
        found = found.when(plain.rlike(f"^0[{prefix}][{digits}]+$"), F.conv(F.substring(plain, 3, 100), base, 10).try_cast("double"))
    return F.when(F.abs(found) < float("inf"), found)
