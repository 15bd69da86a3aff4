"""Size checks in front of broadcast joins.

A side is broadcast only when its measured size is below a bound; above it the
plain join is returned and Spark shuffles both sides on the key.
"""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

log = logging.getLogger(__name__)

# Default bound on the text form of a query-side table that may be broadcast.
MAX_BROADCAST_BYTES = 64 << 20


def checked_broadcast(df: DataFrame, max_bytes: int = MAX_BROADCAST_BYTES,
                      what: str = "table") -> tuple[DataFrame, bool]:
    """Return (df with a broadcast hint, True) if its rows written as JSON take at
    most ``max_bytes``, else (df unchanged, False). Measuring is one distributed
    aggregation, meant for the query-side tables this is used on; it never runs
    on the corpus side."""
    size = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns))))).first()[0] or 0
    if size <= max_bytes:
        return F.broadcast(df), True
    log.info("%s has more than %d bytes: shuffle join instead of broadcast", what, max_bytes)
    return df, False
