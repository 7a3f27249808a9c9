"""String columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vendor_prefix(device="device") -> Column:
    """Vendor part of a hardware address: its first six hex digits."""
    return F.substring(F.col(device) if isinstance(device, str) else device, 1, 6)


def strip_chars(value, chars: str) -> Column:
    """Delete every occurrence of the given characters."""
    return F.translate(F.col(value) if isinstance(value, str) else value, chars, "")


def bracket_fields(value) -> Column:
    """`[a,b,c]` -> array of its fields."""
    return F.split(strip_chars(value, "[]"), ",")


def pseudonym(device, salt: str) -> Column:
    """Salted digest of a device id that keeps the vendor prefix in front."""
    device = F.col(device) if isinstance(device, str) else device
    digest = F.sha2(F.concat(F.lit(salt), device), 256)
    return F.concat(vendor_prefix(device), F.upper(F.substring(digest, 1, 32)))


def wire_line(*fields) -> Column:
    """Join columns into one `|`-separated line."""
    return F.concat_ws("|", *[F.col(f).cast("string") if isinstance(f, str) else f for f in fields])
