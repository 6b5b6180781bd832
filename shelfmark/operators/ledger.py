"""Scratch space: current files, usage, and admission under a quota."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .. import limits
from ..session import scratch_path
from .blocks import BLOCK, with_blocks
from .bounds import after, bounded, paged

OWNER = ["tenant_id", "principal_id"]


def scratch_usage(ledger: DataFrame) -> DataFrame:
    """Bytes and objects each principal holds, from signed deltas."""
    return ledger.groupBy(*OWNER).agg(
        F.sum("delta_bytes").alias("bytes_used"), F.sum("delta_objects").alias("objects_used")
    )


def scratch_state(log: DataFrame) -> DataFrame:
    """Current files from a log of (tenant_id, principal_id, path, seq, op, size): the
    last operation of a path decides, and a deleted path is gone."""
    last = log.groupBy(*OWNER, "path").agg(F.max_by(F.struct("op", "size"), "seq").alias("_l"))
    return last.where(F.col("_l.op") == "write").select(*OWNER, "path", F.col("_l.size").alias("size"))


def scratch_state_usage(state: DataFrame) -> DataFrame:
    return state.groupBy(*OWNER).agg(
        F.sum("size").alias("bytes_used"), F.count("*").alias("objects_used")
    )


def scratch_list(
    state: DataFrame,
    prefix: str = "",
    limit: int | None = limits.SCRATCH_LIST_RESULTS,
    cursor: str | None = None,
) -> DataFrame:
    """Every principal's files below a prefix: the first ``limit`` in path order after
    ``cursor``, or all for ``None``."""
    rows = state.where(F.startswith("path", F.lit(prefix))) if prefix else state
    return bounded(after(rows, "path", cursor), ["path"], limits.size_of(limit), by=OWNER)


def scratch_pages(state: DataFrame, prefix: str = "", size: int = limits.SCRATCH_LIST_RESULTS) -> DataFrame:
    """Every listing page of every principal, with the cursor of the next."""
    rows = state.where(F.startswith("path", F.lit(prefix))) if prefix else state
    return paged(rows, "path", limits.size_of(size), OWNER)


# --- admission -----------------------------------------------------------------
#
# Whether a write is admitted depends on what was admitted before it, so a ledger is
# a fold, not a window. The rows are cut into consecutive blocks of bounded size, and
# every block folds on its own from the usage it opens with. Only a block that opens
# in the middle of a principal's rows needs that usage from its neighbour. Where the
# block's highest running sum fits under the quota from there, nothing in it can be
# rejected and its end is a plain sum. A block that can reject folds once more when its
# opening has become certain; rounds of that are as many as such blocks follow one
# another, and a round reads just those blocks. The answer is the sequential one. The
# driver holds one small record per block, never rows.


def admit_run(deltas: np.ndarray, start: int, quota: int) -> tuple[np.ndarray, np.ndarray]:
    """(admitted, usage after) of consecutive deltas. Runs without a rejection are
    taken by a running sum; only a rejection restarts it."""
    admitted = np.ones(len(deltas), dtype=bool)
    usage = np.empty(len(deltas), dtype=np.int64)
    at, used, stride = 0, start, 64
    while at < len(deltas):
        part = deltas[at : at + stride]
        sums = used + np.cumsum(part)
        over = (sums > quota) & (part > 0)
        hit = int(over.argmax()) if over.any() else -1
        if hit < 0:
            usage[at : at + len(part)] = sums
            used, at, stride = int(sums[-1]), at + len(part), min(stride * 2, 65536)
        else:
            usage[at : at + hit] = sums[:hit]
            used = int(sums[hit - 1]) if hit else used
            admitted[at + hit], usage[at + hit] = False, used
            at, stride = at + hit + 1, max(stride // 2, 16)
    return admitted, usage


class _Fold:
    """Folds sorted blocks batch by batch, carrying the open principal's usage."""

    def __init__(self, quota: int, starts: dict[int, int]):
        self.quota, self.starts = quota, starts

    def batches(self, frames: Iterator[pd.DataFrame]):
        owner, used = None, 0
        block = None
        for frame in (part for whole in frames for _, part in whole.groupby(BLOCK, sort=True)):
            if block != int(frame[BLOCK].iloc[0]):
                block = int(frame[BLOCK].iloc[0])
                used = self.starts.get(block, 0)
                owner = (frame["tenant_id"].iloc[0], frame["principal_id"].iloc[0])
            same = (frame["tenant_id"] == frame["tenant_id"].shift()) & (
                frame["principal_id"] == frame["principal_id"].shift()
            )
            cuts = [*np.flatnonzero(~same.to_numpy()), len(frame)]
            deltas = frame["delta_bytes"].to_numpy(dtype=np.int64)
            admitted = np.empty(len(frame), dtype=bool)
            usage = np.empty(len(frame), dtype=np.int64)
            for lo, hi in zip(cuts, cuts[1:]):
                this = (frame["tenant_id"].iloc[lo], frame["principal_id"].iloc[lo])
                if this != owner:
                    owner, used = this, 0
                admitted[lo:hi], usage[lo:hi] = admit_run(deltas[lo:hi], used, self.quota)
                used = int(usage[hi - 1])
            yield frame.assign(admitted=admitted, usage_after=usage), owner, used

    def rows(self, frames):
        for frame, _, _ in self.batches(frames):
            yield frame.drop(columns=[BLOCK])

    def summary(self, frames):
        """A record per block: its first and last principal, the first one's total and
        highest running sum at a positive delta, and the last one's closing usage."""
        record = None
        for frame, owner, used in self.batches(frames):
            block = int(frame[BLOCK].iloc[0])
            if record is None or record[0] != block:
                if record is not None:
                    yield pd.DataFrame([record], columns=_FIELDS)
                first = (frame["tenant_id"].iloc[0], frame["principal_id"].iloc[0])
                record = [block, *first, *first, 0, _LOWEST, self.starts.get(block, 0), 0]
            own = (frame["tenant_id"] == record[1]) & (frame["principal_id"] == record[2])
            deltas = frame["delta_bytes"].to_numpy(dtype=np.int64)[own.to_numpy()]
            if len(deltas):
                sums = record[5] + np.cumsum(deltas)
                record[5] = int(sums[-1])
                if (deltas > 0).any():
                    record[6] = max(record[6], int(sums[deltas > 0].max()))
            record[3], record[4], record[8] = *owner, used
        if record is not None:
            yield pd.DataFrame([record], columns=_FIELDS)


_LOWEST = -(2**62)
_FIELDS = ["block", "first_t", "first_p", "last_t", "last_p", "total", "peak", "opening", "closing"]
_SUMMARY = (
    "block int, first_t string, first_p string, last_t string, last_p string, "
    "total long, peak long, opening long, closing long"
)


def _summaries(rows: DataFrame, quota: int, starts: dict[int, int]) -> dict[int, Row]:
    found = rows.mapInPandas(_Fold(quota, starts).summary, _SUMMARY).collect()
    return {r.block: r for r in found}


def _openings(known: dict[int, Row], quota: int) -> tuple[dict[int, int], list[int]]:
    """(certain opening usage per block, blocks that must fold from it again)."""
    starts: dict[int, int] = {}
    again: list[int] = []
    before, leaving = None, 0
    for block in sorted(known):
        r = known[block]
        first, last = (r.first_t, r.first_p), (r.last_t, r.last_p)
        opening = leaving if first == before else 0
        if opening is not None:
            starts[block] = opening
        if first != last:
            leaving = r.closing  # the last principal's usage began at zero in this block
        elif opening is None:
            leaving = None
        elif opening + r.peak <= quota:
            leaving = opening + r.total
        elif opening == r.opening:
            leaving = r.closing
        else:
            again.append(block)
            leaving = None  # not known before this block has folded
        before = last
    return starts, again


def _settled_starts(rows: DataFrame, quota: int) -> dict[int, int]:
    """The usage every block opens with."""
    known = _summaries(rows, quota, {})
    starts, again = _openings(known, quota)
    if not again:
        return starts
    # Blocks in the middle of one principal's rows, laid out so that a round can read
    # only those it needs.
    inner = [b for b, r in known.items() if (r.first_t, r.first_p) == (r.last_t, r.last_p)]
    path = scratch_path(rows.sparkSession, "blocks")
    rows.where(F.col(BLOCK).isin(inner)).write.partitionBy(BLOCK).parquet(path)
    stored = rows.sparkSession.read.schema(rows.schema).parquet(path)
    while again:
        part = stored.where(F.col(BLOCK).isin(again)).select(rows.columns)
        ordered = part.repartition(BLOCK).sortWithinPartitions(BLOCK, *OWNER, "seq")
        known.update(_summaries(ordered, quota, starts))
        starts, again = _openings(known, quota)
    return starts


def quota_replay(ledger: DataFrame, quota: int, blocks: int | None = None) -> DataFrame:
    """The ledger in admission order per principal, each row with ``admitted`` and
    ``usage_after``. A positive delta that would exceed ``quota`` is rejected and
    leaves usage alone; ``seq`` must be unique within a principal."""
    wanted = ledger.select(*OWNER, "seq", F.col("delta_bytes").cast("long").alias("delta_bytes"))
    rows = with_blocks(wanted, OWNER, ["seq"], blocks, sort=True)
    schema = "tenant_id string, principal_id string, seq long, delta_bytes long, admitted boolean, usage_after long"
    starts = _settled_starts(rows, quota)
    return rows.mapInPandas(_Fold(quota, starts).rows, schema)


def quota_report(replayed: DataFrame) -> DataFrame:
    """Per principal: bytes held, writes admitted and rejected."""
    kept = F.when(F.col("admitted"), F.col("delta_bytes")).otherwise(0)
    return replayed.groupBy(*OWNER).agg(
        F.sum(kept).alias("bytes_used"),
        F.count_if("admitted").alias("admitted"),
        F.count_if(~F.col("admitted")).alias("rejected"),
    )
