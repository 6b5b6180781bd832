"""The scheduled sweep: heal the drift between stored objects and the catalog."""

from __future__ import annotations

from datetime import datetime
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import limits
from ..functions import keys
from ..operators.catalog import PK
from ..operators.upkeep import reconcile_report, reconcile_states
from ..session import cut_lineage
from ..sinks.tables import tombstones


class Sweep(NamedTuple):
    states: DataFrame
    report: DataFrame
    enqueue: DataFrame  # object keys to extract again
    tombstones: DataFrame  # rows to append


def reconcile(
    objects: DataFrame,
    entries: DataFrame,
    now: datetime,
    grace_seconds: int = limits.RECONCILE_GRACE_SECONDS,
) -> Sweep:
    """All tenants and namespaces in one join. A second sweep after the first one's
    writes finds nothing to do."""
    states = cut_lineage(reconcile_states(objects, entries, now, grace_seconds))
    again = states.where(F.col("action") == "enqueue")
    orphans = states.where(F.col("action") == "tombstone")
    return Sweep(
        states,
        reconcile_report(states),
        again.select(keys.originals_key(*(F.col(c) for c in PK)).alias("key")),
        tombstones(entries, orphans, now),
    )
