"""Shared column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Runs of the six white-space bytes that part words.
SPACES = r"[\x20\x09-\x0D]+"
WORDS = r"[^\x20\x09-\x0D]+"


def hash_long(text: Column, digits: int = 13) -> Column:
    """The first hexadecimal digits of the MD5 of ``text`` as a non-negative long."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id, written as text, modulo ``divisor``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % divisor
