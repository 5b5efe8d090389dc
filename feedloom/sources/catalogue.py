"""The source catalogue: a YAML file of source specifications, checked and turned into a table."""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.failures import bad

SOURCE_ID = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.:-]{0,191}")
#: Bounds of a specification's numbers: priority, timeout, slots, attempts, base and longest delay, backfill window.
BOUNDS = {
    "priority": (0, 999, 20), "timeout_seconds": (1, 86_400, 300), "slot_cost": (1, 128, 1), "max_attempts": (1, 100, 3), "base_seconds": (0, 86_400, 30),
    "max_seconds": (1, 604_800, 3600), "backfill_window_seconds": (60, 2**31, 86_400),
}
LEAST_SECONDS = 10
NEEDS = {"interval": "seconds", "cron": "cron", "once": "at"}
COLUMNS = "source_id string, fetcher string, sink string, enabled boolean, queue string, schedule_type string, seconds int, cron string, timezone string, spec string, config_hash string, " + ", ".join(f"{k} int" for k in BOUNDS)


def canonical(value: object) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), default=str)


def checked(spec: dict) -> dict:
    """A specification with its defaults; what isn't allowed is a failure of the configuration."""
    name = str(spec.get("id", ""))
    if not SOURCE_ID.fullmatch(name):
        raise bad(f"no source id: {name!r}")
    schedule = spec.get("schedule") or {}
    kind = schedule.get("type")
    if kind not in NEEDS or not schedule.get(NEEDS[kind]):
        raise bad(f"{name}: a schedule of type {kind!r} without {NEEDS.get(kind, 'a known type')}")
    if kind == "interval" and int(schedule["seconds"]) < LEAST_SECONDS:
        raise bad(f"{name}: an interval of less than {LEAST_SECONDS} seconds")
    given = {**spec, **(spec.get("routing") or {}), **(spec.get("retry") or {})}
    numbers = {k: int(given.get(k, default)) for k, (_, _, default) in BOUNDS.items()}
    for k, (low, high, _) in BOUNDS.items():
        if not low <= numbers[k] <= high:
            raise bad(f"{name}: {k} must be from {low} to {high}")
    text = canonical(spec)
    return {
        "source_id": name, "fetcher": spec.get("fetcher"), "sink": spec.get("sink", "postgres"), "enabled": bool(spec.get("enabled", True)), "queue": given.get("queue", "default"), "schedule_type": kind,
        "seconds": schedule.get("seconds"), "cron": schedule.get("cron"), "timezone": schedule.get("timezone", "UTC"), "spec": text, "config_hash": hashlib.sha256(text.encode()).hexdigest()[:16], **numbers,
    }


def load(spark: SparkSession, path: str) -> tuple[DataFrame, str]:
    """The sources of a catalogue file and its version, 16 digits of the hash of its content; an id that stands twice is an error."""
    import yaml

    with open(path, encoding="utf-8") as f:
        value = yaml.safe_load(f) or {}
    rows = [checked(s) for s in value.get("sources") or ()]
    twice = {r["source_id"] for r in rows if sum(x["source_id"] == r["source_id"] for x in rows) > 1}
    if twice:
        raise bad(f"ids that stand twice: {', '.join(sorted(twice))}")
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], COLUMNS), hashlib.sha256(canonical(value).encode()).hexdigest()[:16]


def judged(specs: DataFrame) -> DataFrame:
    """Specifications in columns with `error`, what is wrong first: id, schedule, seconds, or the name of a number that is out of its bounds.

    specs: source_id, schedule_type, seconds, cron, once_at and any of the numbers in BOUNDS; a null number has its default."""
    known = F.coalesce(F.col("source_id").rlike(f"^(?:{SOURCE_ID.pattern})$"), F.lit(False))
    given = F.when(F.col("schedule_type") == "interval", F.col("seconds").isNotNull()).when(F.col("schedule_type") == "cron", F.coalesce("cron", F.lit("")) != "").when(F.col("schedule_type") == "once", F.col("once_at").isNotNull())
    error = F.when(~known, "id").when(~F.coalesce(given, F.lit(False)), "schedule").when((F.col("schedule_type") == "interval") & (F.col("seconds") < LEAST_SECONDS), "seconds")
    for name, (low, high, _) in BOUNDS.items():
        if name in specs.columns:
            error = error.when(~F.coalesce(F.col(name).between(low, high), F.lit(True)), name)
    return specs.withColumn("error", error)
