"""Commands: build a history, update it from change files or replication folders, take snapshots.

``run`` does what a configuration (JSON) says: db, and any of source (build if there's no history), hourly and minutely
(replication folders), changes (a folder of change files), snapshots (a list of latest, day, week).
"""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession

from .plans.files import Store
from .plans.history import History
from .plans.locks import lock
from .sources import osm_pbf, osm_xml
from .streaming import replication

LIMITS = {"build": 2 * 24 * 3600, "update": 3600, "snapshot": 24 * 3600}


def source(spark: SparkSession, path: str):
    if path.endswith(".pbf"):
        return osm_pbf.read_objects(spark, path)
    return osm_xml.read_objects(spark, path) if ".osm" in path or path.endswith(".xml") else spark.read.parquet(path)


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="quadstrata")
    sub = p.add_subparsers(dest="command", required=True)
    for name, places in (("build", ("source", "db")), ("add", ("source", "db")), ("update", ("changes", "db")), ("catchup", ("hourly", "minutely", "db")), ("snapshot", ("db",)), ("run", ("configuration",))):
        c = sub.add_parser(name)
        for place in places:
            c.add_argument(place)
        if name == "snapshot":
            c.add_argument("period", nargs="?", default="latest", choices=("latest", "day", "week"))
    a = p.parse_args(args)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command != "run":
        return step(spark, a.command, vars(a))
    c = json.loads(Store(spark).read(a.configuration))
    todo = [("build", c)] if "source" in c and History.try_load(spark, c["db"]) is None else []
    todo += [("catchup", {"hourly": None, "minutely": None} | c)] if "hourly" in c or "minutely" in c else []
    todo += [("update", c)] if "changes" in c else []
    todo += [("snapshot", c | {"period": x}) for x in c.get("snapshots", [])]
    return max([step(spark, name, given) for name, given in todo], default=0)


def step(spark: SparkSession, command: str, a: dict) -> int:
    """One command under its lock; 1 if it is locked."""
    db = a["db"].rstrip("/")
    kind = {"add": "build", "catchup": "update"}.get(command, command)
    with lock(Store(spark), f"{db}.{kind}.lock", LIMITS[kind]) as taken:
        if not taken:
            print(f"{db} is locked")
            return 1
        if command == "build":
            History.create(spark, db, source(spark, a["source"]))
        elif command == "add":
            History(spark, db).add(source(spark, a["source"]))
        elif command == "update":
            replication.replicate(spark, db, a["changes"], f"{db}.checkpoint").awaitTermination()
        elif command == "catchup":
            replication.catch_up(spark, db, a["hourly"], a["minutely"])
        else:
            replication.scheduled_snapshot(spark, db, a["period"])
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
