"""Sets of keys that every task holds, so that the tables they are looked up in stay where they are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to so many keys are joined as they are: Spark sends them to the tasks anyway.
PLAIN = 20_000
#: Up to so many masks are sent to the tasks, some 100 MB; sets beyond that are joined as they are.
MASKS = 2_000_000


def _word(kind: Column, id_: Column) -> Column:
    """One bigint for a type and 64 neighbouring ids."""
    return F.shiftright(id_, 6) * F.lit(8) + kind.cast("long")


def _bit(id_: Column) -> Column:
    return id_.bitwiseAND(F.lit(63)).cast("int")


class KeySet:
    """The keys (type, id, not necessarily distinct) as masks of 64 ids each: exact, and for dense ids a small part of the keys.

    hold: what to do with the masks, which are used more than once.
    """

    def __init__(self, keys: DataFrame, hold: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.keys, self.masks = keys.select("type", "id"), None
        if self.keys.count() > PLAIN:
            one = F.call_function("shiftleft", F.lit(1).cast("long"), _bit(F.col("id")))
            masks = hold(self.keys.groupBy(_word(F.col("type"), F.col("id")).alias("_word")).agg(F.bit_or(one).alias("_mask")))
            if masks.count() <= MASKS:
                self.masks = masks

    def keep(self, df: DataFrame, kind: str = "type", id_: str = "id") -> DataFrame:
        """The rows of df whose key is in the set."""
        return self._join(df, kind, id_, "left_semi")

    def drop(self, df: DataFrame, kind: str = "type", id_: str = "id") -> DataFrame:
        """The rows of df whose key isn't in the set."""
        return self._join(df, kind, id_, "left_anti")

    def _join(self, df: DataFrame, kind: str, id_: str, how: str) -> DataFrame:
        if self.masks is None:
            return df.join(self.keys.select(F.col("type").alias("_type"), F.col("id").alias("_id")), (df[kind] == F.col("_type")) & (df[id_] == F.col("_id")), how)
        found = F.call_function("shiftright", F.col("_mask"), _bit(df[id_])).bitwiseAND(F.lit(1)) == 1
        return df.join(F.broadcast(self.masks), (_word(df[kind], df[id_]) == F.col("_word")) & found, how)
