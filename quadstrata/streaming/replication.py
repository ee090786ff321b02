"""Change files, from a stream or from replication folders: each becomes a diff layer, with compaction as hours and days end.

A layer's metadata names the file it came from (``file``), or the period and sequence number of its
replication diff (``period``, ``sequence_number``).  All steps can be run again after a failure: a
file that has a layer is not applied twice, but its compaction is made if it is missing; a file
that comes late, older than the latest layer and in none, raises an error and is not passed over.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.times import from_unix, start_of_week, to_unix
from ..plans.files import Store
from ..plans.history import History
from ..plans.layers import Layer
from ..sources.osm_xml import read_changes

STAMP = re.compile(r"(\d{8}-\d{6})\.osc(?:\.gz)?$")
MINUTE, HOUR, DAY, WEEK = 60, 3600, 24 * 3600, 7 * 24 * 3600


class LateFile(ValueError):
    """A change file is older than the latest layer and none has it."""


def moment_of(path: str) -> int | None:
    m = STAMP.search(path)
    return int(datetime.strptime(m[1], "%Y%m%d-%H%M%S").replace(tzinfo=timezone.utc).timestamp()) if m else None


def compact_after(history: History, moment: int) -> Layer | None:
    """The diff for the day or hour that the layer at a moment begins anew, unless it is there."""
    before = history.previous(moment)
    if before is None:
        return None
    then, now = from_unix(before.head.id), from_unix(moment)
    if now.date() != then.date():
        return history.take_diff_snapshot(moment, DAY)
    if now.hour != then.hour and moment - history.layers[0].id >= HOUR:
        return history.take_diff_snapshot(moment, HOUR)
    return None


def apply_file(spark: SparkSession, db: str, path: str) -> list[Layer]:
    """Apply one change file named by the moment it brings the history to; compact the day or hour that it begins anew. Returns the layers made."""
    history, moment, name = History(spark, db), moment_of(path), path.rsplit("/", 1)[-1]
    if moment is None:
        raise ValueError(f"{name} isn't named by a moment")
    made: list[Layer | None] = []
    if moment > history.latest_id:
        made.append(history.apply_diff(read_changes(spark, path), moment, {"file": name, "period": "hour" if moment % HOUR == 0 else "minute"}))
    elif name not in {x.meta.get("file") for x in history.layers}:
        raise LateFile(f"{name} came after a layer at {from_unix(history.latest_id):%Y-%m-%d %H:%M:%S}")
    made.append(compact_after(history, moment))
    return [x for x in made if x]


def replicate(spark: SparkSession, db: str, folder: str, checkpoint: str, once: bool = True):
    """Follow a folder of change files; with once, stop when those there are applied."""

    def batch(files: DataFrame, _: int) -> None:
        for r in sorted(files.select("path").collect(), key=lambda r: moment_of(r.path) or 0):  # one row for each new file, not its content
            apply_file(files.sparkSession, db, r.path)

    stream = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.osc*").option("maxFilesPerTrigger", 60).schema("path string, modificationTime timestamp, length bigint, content binary").load(folder).select(F.col("path"))
    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")).start()


@dataclass(frozen=True)
class State:
    sequence_number: int
    timestamp: int


class ReplicationFolder:
    """Numbered diffs of one period as they are published: state.txt for the latest, NNN/NNN/NNN.state.txt and .osc.gz for each."""

    def __init__(self, spark: SparkSession, path: str, period: int):
        self.store, self.path, self.period = Store(spark), path.rstrip("/"), period

    def place(self, sequence_number: int, ending: str) -> str:
        n = f"{sequence_number:09d}"
        return f"{self.path}/{n[:3]}/{n[3:6]}/{n[6:]}.{ending}"

    def _state(self, path: str) -> State | None:
        if not self.store.exists(path):
            return None
        found = dict(line.split("=", 1) for line in self.store.read(path).splitlines() if "=" in line and not line.startswith("#"))
        stamp = datetime.strptime(found["timestamp"].replace("\\", "").strip(), "%Y-%m-%dT%H:%M:%SZ")
        return State(int(found["sequenceNumber"]), to_unix(stamp))

    def latest(self) -> State | None:
        return self._state(f"{self.path}/state.txt")

    def state(self, sequence_number: int) -> State | None:
        return self._state(self.place(sequence_number, "state.txt"))

    def after(self, moment: int) -> State | None:
        """The first diff that ends after a moment, by bisection over the numbers; None if there is none yet."""
        last = self.latest()
        if last is None or last.timestamp <= moment:
            return None
        low, high = 0, last.sequence_number  # the first is in (low, high]; numbers may begin anywhere
        while high - low > 1:
            mid = (low + high) // 2
            found = self.state(mid)
            low, high = (low, mid) if found and found.timestamp > moment else (mid, high)
        return self.state(high) or last

    def next(self, layer: Layer) -> State | None:
        """Where to go on from a layer: after its sequence number if it is of this period, else after its moment."""
        if str(layer.meta.get("period")) == str(self.period) and "sequence_number" in layer.meta:
            return self.state(int(layer.meta["sequence_number"]) + 1)
        return self.after(layer.id)


def apply_state(spark: SparkSession, db: str, folder: ReplicationFolder, state: State) -> list[Layer]:
    history = History(spark, db)
    made = []
    if state.timestamp > history.latest_id:
        made.append(history.apply_diff(read_changes(spark, folder.place(state.sequence_number, "osc.gz")), state.timestamp, {"period": folder.period, "sequence_number": state.sequence_number}))
    made.append(compact_after(history, state.timestamp))
    return [x for x in made if x]


def catch_up(spark: SparkSession, db: str, hourly: str | None, minutely: str | None, now: int | None = None, most: int = 60) -> list[Layer]:
    """Apply what is published since the latest layer: more than an hour behind one hourly diff after the other, then minutely ones, ``most`` diffs in all."""
    now = int(datetime.now(timezone.utc).timestamp()) if now is None else now
    made: list[Layer] = []
    history = History(spark, db)
    if made_up := compact_after(history, history.latest_id):  # left over from a failure
        made.append(made_up)
    for _ in range(most):
        latest = History(spark, db)
        # meta of the finest layer: compaction has none of its own
        head = latest.view(latest.latest_id, smallest=True).head
        found = None
        if hourly and now - head.id > HOUR:
            folder = ReplicationFolder(spark, hourly, HOUR)
            found = folder.next(head)
        if found is None and minutely:
            folder = ReplicationFolder(spark, minutely, MINUTE)
            found = folder.next(head)
        if found is None:
            break
        made += apply_state(spark, db, folder, found)
    return made


def scheduled_snapshot(spark: SparkSession, db: str, period: str = "latest") -> Layer | None:
    """A snapshot of what changed: up to the latest layer over a day, or up to the day's or week's first moment."""
    history = History(spark, db)
    now = from_unix(history.latest_id)
    if period == "latest":
        return history.take_snapshot(None, DAY)
    if period == "day":
        return history.take_snapshot(now.replace(hour=0, minute=0, second=0), DAY)
    if period == "week":
        return history.take_snapshot(start_of_week(now), WEEK)
    raise ValueError(f"no period {period}")
