"""Rows in the order of an id, over parts of about equal size, with one shuffle.

Order: null ids first, then by id, rows of one id in the order read.  Parts are cut at rows drawn
from the table, at most ``SAMPLE`` of them, so one id may well fill many parts.  The row numbers
must repeat: the table has to be a plan that does, such as a scan.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions

SAMPLE = 500_000
#: Parts for each partition of the input: a part is a fraction of what a task reads.
FINER = 2


def with_row_numbers(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text, rid."""
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("rid"))


class Cuts:
    """The first row of each part but the first."""

    def __init__(self, null_rids: np.ndarray, ids: np.ndarray, rids: np.ndarray):
        self.null_rids, self.ids, self.rids = null_rids, ids, rids

    @property
    def parts(self) -> int:
        return len(self.null_rids) + len(self.ids) + 1

    def place(self, ids: pa.Array, rids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The part of each row, and whether the row is the first of its part (of part 0: not known here)."""
        null, rid = ids.is_null().to_numpy(zero_copy_only=False), rids.to_numpy()
        part, first = np.zeros(len(rid), np.int64), np.zeros(len(rid), bool)
        for at in [np.flatnonzero(null)]:
            part[at] = np.searchsorted(self.null_rids, rid[at], side="right")
            first[at] = np.isin(rid[at], self.null_rids)
        at = np.flatnonzero(~null)
        if len(at):
            own = ids.drop_null().to_numpy(zero_copy_only=False)
            lo, hi = np.searchsorted(self.ids, own), np.searchsorted(self.ids, own, side="right")
            part[at] = lo + len(self.null_rids)
            for k in np.flatnonzero(lo < hi).tolist():  # ids at which a part is cut
                a, b = lo[k], hi[k]
                n = int(np.searchsorted(self.rids[a:b], rid[at[k]], side="right"))
                part[at[k]] += n
                first[at[k]] = n > 0 and self.rids[a + n - 1] == rid[at[k]]
        return part, first


def cuts(numbered: DataFrame, lowest: tuple | None, parts: int | None = None) -> Cuts:
    """Where to cut numbered (id, rid, ...) into parts; lowest: the id and row number of the first row of all, None if there's none."""
    parts = parts or FINER * partitions(numbered)
    none = np.empty(0, np.int64)
    if lowest is None or parts == 1:
        return Cuts(none, none, none)
    total = numbered.count()
    want = min(SAMPLE, 100 * parts)
    drawn = (numbered.select("id", "rid") if total <= want else numbered.select("id", "rid").sample(want / total, 42)).toArrow().sort_by([("id", "ascending"), ("rid", "ascending")])  # nulls go last
    n_null = drawn.column("id").null_count
    order = np.concatenate((np.arange(len(drawn) - n_null, len(drawn)), np.arange(len(drawn) - n_null)))
    pick = np.unique(order.size * np.arange(1, parts) // parts) if len(drawn) else none
    rows = drawn.take(pa.array(order[pick]))
    keep = [k for k, (i, r) in enumerate(zip(rows.column("id").to_pylist(), rows.column("rid").to_pylist())) if (i, r) != lowest]
    rows = rows.take(pa.array(keep, pa.int64()))
    null = rows.column("id").is_null().to_numpy()
    rid = rows.column("rid").to_numpy()
    return Cuts(rid[null], rows.column("id").drop_null().to_numpy(), rid[~null])


def lowest(numbered: DataFrame) -> tuple | None:
    """id and row number of the first row."""
    row = numbered.agg(F.min(F.struct(F.col("id").isNotNull().alias("has"), "id", "rid")).alias("low")).first()[0]
    return None if row is None else (row.id, row.rid)


def in_order(tagged: DataFrame, parts: int, *order: str) -> DataFrame:
    """tagged by its column part: each part in a task of its own, and sorted."""
    return tagged.repartitionById(parts, F.col("part").cast("int")).sortWithinPartitions("part", *order)
