"""Time parsing: cutoffs on the driver, record timestamps as Column expressions."""

from __future__ import annotations

import re
import time
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

# Milliseconds of a duration unit.
UNITS = {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}


def now_ms() -> int:
    return time.time_ns() // 1_000_000


def parse_since(spec: str | None) -> int | None:
    """A duration back from now, an ISO date, or nothing for no cutoff; what cannot be parsed is no cutoff."""
    text = (spec or "").strip()
    if text.lower() in ("", "all", "none"):
        return None
    if found := re.fullmatch(r"(\d+)\s*([smhdwSMHDW])", text):
        return now_ms() - int(found[1]) * UNITS[found[2].lower()]
    try:
        moment = datetime.fromisoformat(text)
    except ValueError:
        return None
    return int((moment if moment.tzinfo else moment.replace(tzinfo=timezone.utc)).timestamp() * 1000)


def epoch_ms(variant: Column) -> Column:
    """D3: milliseconds from a VARIANT that holds a number, digits, or an ISO time (no zone: UTC)."""
    kind = F.schema_of_variant(variant)
    text = F.trim(F.try_variant_get(variant, "$", "string"))
    number = F.when(kind.rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.try_variant_get(variant, "$", "double").cast("bigint"))
    digits = F.when((kind == "STRING") & text.rlike(r"^\d+$"), text.try_cast("bigint"))
    iso = F.when(kind == "STRING", F.unix_millis(F.try_to_timestamp(text)))
    exact = F.when(kind == "BIGINT", F.try_variant_get(variant, "$", "bigint"))
    return F.coalesce(exact, number, digits, iso)
