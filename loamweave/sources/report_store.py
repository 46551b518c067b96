"""Sets of community reports as Parquet folders on any Hadoop path: staged, read again, made active by a pointer, marked stale."""

from __future__ import annotations

import json
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from loamweave.operators.reports import COLUMNS, COUNTER, SCHEMA
from loamweave.sources import files

POINTER, FOLDER = "active_reports.json", "report_builds"
FIELDS = ("report_schema", "build_id", "report_count", "counter_id", "generated_at", "stale_at", "stale_producer", "stale_reason")


def _now() -> str:
    return datetime.now(timezone.utc).isoformat()


def build_path(root: str, build_id: str) -> str:
    """Folder of a build; a name that leads elsewhere raises."""
    if not build_id or build_id in (".", "..") or "/" in build_id or "\\" in build_id:
        raise ValueError(f"not a build id: {build_id!r}")
    return f"{root}/{FOLDER}/{build_id}"


def stage_set(reports: DataFrame, root: str, build_id: str, now: str | None = None) -> dict:
    """Write a new set and its manifest; a build id taken already raises, a failure leaves a mark."""
    spark = reports.sparkSession
    where = build_path(root, build_id)
    if files.exists(spark, where):
        raise RuntimeError(f"build exists: {build_id}")
    try:
        reports.select(*COLUMNS).write.mode("errorifexists").parquet(f"{where}/reports")
        count = spark.read.parquet(f"{where}/reports").count()
        manifest = dict.fromkeys(FIELDS) | {"report_schema": SCHEMA, "build_id": build_id, "report_count": count, "counter_id": COUNTER, "generated_at": now or _now()}
        files.write(spark, f"{where}/manifest.json", json.dumps(manifest, sort_keys=True))
    except Exception as e:
        record_failure(spark, root, build_id, f"{type(e).__name__}: {e}")
        raise
    return manifest


def record_failure(spark: SparkSession, root: str, build_id: str, reason: str) -> None:
    files.write(spark, f"{build_path(root, build_id)}/failed.txt", reason)


def read_set(spark: SparkSession, root: str, build_id: str) -> tuple[DataFrame, dict] | None:
    """(reports, manifest) of a build; None if a part is missing or has other fields."""
    try:
        where = build_path(root, build_id)
        if not files.exists(spark, f"{where}/manifest.json") or not files.exists(spark, f"{where}/reports"):
            return None
        manifest = json.loads(files.read(spark, f"{where}/manifest.json"))
    except ValueError:
        return None
    if not isinstance(manifest, dict) or set(manifest) != set(FIELDS):
        return None
    reports = spark.read.parquet(f"{where}/reports")
    return (reports, manifest) if set(reports.columns) == set(COLUMNS) else None


def activate(spark: SparkSession, root: str, build_id: str) -> None:
    """Make a readable set the active one."""
    if read_set(spark, root, build_id) is None:
        raise RuntimeError(f"unreadable set: {build_id}")
    files.write(spark, f"{root}/{POINTER}", json.dumps({"active_build": build_id}))


def active_id(spark: SparkSession, root: str) -> str | None:
    if not files.exists(spark, f"{root}/{POINTER}"):
        return None
    try:
        pointer = json.loads(files.read(spark, f"{root}/{POINTER}"))
    except ValueError:
        return None
    name = pointer.get("active_build") if isinstance(pointer, dict) and set(pointer) == {"active_build"} else None
    try:
        return name if isinstance(name, str) and files.exists(spark, build_path(root, name)) else None
    except ValueError:
        return None


def read_active(spark: SparkSession, root: str) -> tuple[DataFrame, dict] | None:
    name = active_id(spark, root)
    return read_set(spark, root, name) if name else None


def mark_stale(spark: SparkSession, root: str, producer: str, reason: str, now: str | None = None) -> bool:
    """Note on the active set that its graph has changed; whether there was one."""
    name = active_id(spark, root)
    got = read_set(spark, root, name) if name else None
    if got is None:
        return False
    files.write(spark, f"{build_path(root, name)}/manifest.json", json.dumps(got[1] | {"stale_at": now or _now(), "stale_producer": producer, "stale_reason": reason}, sort_keys=True))
    return True
