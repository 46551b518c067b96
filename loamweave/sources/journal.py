"""Tasks to be done after a build is published, kept until they are done, so a failure after the commit loses none."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import SparkSession

from loamweave.sources import files

FOLDER = "post_commit"
STATES = ("prepared", "pending", "done")


def _path(root: str, task_id: str) -> str:
    if not task_id or "/" in task_id or "\\" in task_id or task_id.startswith("."):
        raise ValueError(f"not a task id: {task_id!r}")
    return f"{root}/{FOLDER}/{task_id}/task.json"


def _save(spark: SparkSession, root: str, task: dict) -> dict:
    files.write(spark, _path(root, task["task_id"]), json.dumps(task, sort_keys=True))
    return task


def prepare(spark: SparkSession, root: str, kind: str, build_id: str, generation: int) -> dict:
    """Note a task before the commit; the same task of the same build is noted once."""
    task_id = f"{kind}_{build_id}"
    if files.exists(spark, _path(root, task_id)):
        return json.loads(files.read(spark, _path(root, task_id)))
    now = datetime.now(timezone.utc).isoformat()
    return _save(spark, root, {"task_id": task_id, "kind": kind, "build_id": build_id, "generation": generation, "state": "prepared", "prepared_at": now, "attempts": 0})


def tasks(spark: SparkSession, root: str) -> list[dict]:
    found = [json.loads(files.read(spark, f"{f}/task.json")) for f in files.folders(spark, f"{root}/{FOLDER}")]
    return sorted(found, key=lambda t: (t["generation"], t["task_id"]))


def retry(spark: SparkSession, root: str, published: int, work: dict[str, Callable[[dict], None]]) -> list[dict]:
    """Do the tasks that are not done of builds up to the published generation; one that fails stays pending. Work must bear being done twice."""
    out = []
    for task in tasks(spark, root):
        if task["state"] == "done" or task["generation"] > published or task["kind"] not in work:
            continue
        try:
            work[task["kind"]](task)
            state, error = "done", None
        except Exception as e:  # noqa: BLE001  is tried again
            state, error = "pending", f"{type(e).__name__}: {e}"
        out.append(_save(spark, root, task | {"state": state, "attempts": task["attempts"] + 1, "error": error}))
    return out
