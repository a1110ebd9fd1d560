"""Seeded pseudo-random order and draws that depend on the row's key only.

The outcome is the same whatever the partitioning, and the same again when a task is rerun. Every
use has its own purpose in the digest, so a sample, a split of it and its folds are independent.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowgauge.functions.cells import cell

# Number of values a draw can take.
DRAWS = 2**32

# Hex digits of a digest that make an index: 60 bits, evenly spread over any size of table.
INDEX_CHARS = 15


def digest_of(text: Column, purpose: str, seed: int) -> Column:
    """MD5 of 'purpose:text:seed' as hex text; sorting by it gives a random order."""
    return F.md5(F.concat(F.lit(f"{purpose}:"), text, F.lit(f":{seed}")))


def digest(key: str, purpose: str, seed: int) -> Column:
    """Digest of a key; '=' marks a key that is there, so null is a key of its own."""
    present = F.concat(F.lit("="), cell(key).cast("string"))
    return digest_of(F.coalesce(present, F.lit("")), purpose, seed)


def draw(key: str, purpose: str, seed: int) -> Column:
    """32-bit number taken from the digest, as bigint; never null."""
    return F.conv(F.substring(digest(key, purpose, seed), 1, 8), 16, 10).cast("bigint")


def drawn_index(position: Column, size: Column, seed: int) -> Column:
    """Pseudo-random index 0..size-1 for each draw position, drawn with replacement."""
    hexadecimal = F.substring(digest_of(position.cast("string"), "bootstrap", seed), 1, INDEX_CHARS)
    return F.conv(hexadecimal, 16, 10).cast("bigint") % size
