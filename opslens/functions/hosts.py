"""Client address helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def host_normalize(host: Column) -> Column:
    """Client host without its port.

    ``[v6]:port`` and ``[v6]`` give the bracketed address, more than one colon drops the last
    component, anything else is cut at the colon and to four dot labels.
    """
    colons = F.length(host) - F.length(F.replace(host, F.lit(":"), F.lit("")))
    bracketed = F.substring_index(F.regexp_replace(host, r"^\[", ""), "]", 1)
    bare_v6 = F.regexp_replace(host, r":[^:]*$", "")
    plain = F.substring_index(F.substring_index(host, ":", 1), ".", 4)
    return (
        F.when(host.rlike(r"^\[[^\]]*\](:|$)"), bracketed).when(colons > 1, bare_v6).otherwise(plain)
    )
