"""Index builds as Parquet folders on any Hadoop path, with validation, a lock, a pointer to the published one and tasks after it."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import os
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamweave.functions.vectors import finite
from loamweave.sources import files, journal

LAYOUT = "sparse_chunks+dense_chunks"
FORMAT = 4
#: States of a build and where they may go.
NEXT = {"building": ("validated", "failed"), "validated": ("published", "failed"), "published": ("superseded",), "superseded": ("published",), "failed": ()}
_HELD: dict[str, tuple[threading.RLock, list]] = {}
_GUARD = threading.Lock()


class BuildError(RuntimeError):
    pass


def _session() -> SparkSession:
    return SparkSession.active()


def stable_hash(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def short_hash(value: str | bytes | None) -> str:
    """First twelve digits of a hash, of a lexicon's bytes or a tokenizer's name; '' for None."""
    return "" if value is None else hashlib.sha256(value.encode() if isinstance(value, str) else value).hexdigest()[:12]


def build_name(now: datetime | None = None) -> str:
    return f"build_{(now or datetime.now(timezone.utc)).strftime('%Y%m%dT%H%M%S%f')}_{uuid.uuid4().hex}"


def _local(root: str | Path) -> Path | None:
    text = str(root)
    return Path(text.removeprefix("file://")) if text.startswith("file:/") or "://" not in text else None


@contextlib.contextmanager
def lock(root: str | Path, wait: float = 0.0) -> Iterator[None]:
    """One writer at a time; a second one fails after ``wait`` seconds. The thread that holds it may take it again.

    On a local path the operating system holds it, elsewhere a file that only one writer
    can create.
    """
    home = _local(root)
    key = str(home.resolve() if home else root)
    with _GUARD:
        inner, held = _HELD.setdefault(key, (threading.RLock(), []))
    until = time.monotonic() + wait
    if not inner.acquire(timeout=max(0.0, wait)) if wait else not inner.acquire(blocking=False):
        raise BuildError("another build is running")
    try:
        if held:  # taken by this thread
            held.append(None)
            yield
            return
        release = _take(root, home, until)
        held.append(release)
        try:
            yield
        finally:
            held.pop()
            release()
    finally:
        if held and held[-1] is None:
            held.pop()
        inner.release()


def _take(root: str | Path, home: Path | None, until: float) -> Callable[[], None]:
    while True:
        if home:
            home.mkdir(parents=True, exist_ok=True)
            f = (home / ".lock").open("w")
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                return f.close
            except OSError:
                f.close()
        elif files.claim(_session(), f"{root}/.lock"):
            return lambda: files.drop(_session(), [f"{root}/.lock"])
        if time.monotonic() >= until:
            raise BuildError("another build is running")
        time.sleep(0.05)


SPARSE_COLUMNS = ("chunk_id", "fts_text")
DENSE_COLUMNS = ("chunk_id", "vector")


def faults(sparse: DataFrame, dense: DataFrame, dim: int) -> list[str]:
    """What keeps two chunk tables from being published; one aggregation a table, and what the tables must share."""
    out = [f"{name} lacks {sorted(set(need) - set(df.columns))}" for name, df, need in (("sparse", sparse, SPARSE_COLUMNS), ("dense", dense, DENSE_COLUMNS)) if set(need) - set(df.columns)]
    if out:
        return out
    s = sparse.agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("d"), F.sum(F.coalesce((F.trim("fts_text") == "").cast("int"), F.lit(1))).alias("bare")).first()
    v = dense.agg(F.count("*").alias("n"), F.countDistinct("chunk_id").alias("d"), F.sum((~finite(F.col("vector"), dim)).cast("int")).alias("bad")).first()
    out = [f"{name} is empty" for name, r in (("sparse", s), ("dense", v)) if not r["n"]]
    out += [f"{name} repeats chunk ids" for name, r in (("sparse", s), ("dense", v)) if r["n"] != r["d"]]
    out += ([f"{s['bare']} sparse chunks without search text"] if s["bare"] else []) + ([f"{v['bad']} vectors are unusable"] if v["bad"] else [])
    stray = dense.join(sparse, "chunk_id", "left_anti").count()
    out += [f"{stray} vectors without a chunk"] if stray else []
    if "chunk_kind" in sparse.columns:
        bare = sparse.where("chunk_kind = 'dense'").join(dense, "chunk_id", "left_anti").count()
        out += [f"{bare} dense chunks without a vector"] if bare else []
    probe = exact_probe(sparse).first()
    if probe and probe["term"] and sparse.where(F.array_contains(F.split("fts_text", r"\s+"), probe["term"])).isEmpty():
        out.append(f"the term {probe['term']!r} is not found")
    return out


def exact_probe(sparse: DataFrame) -> DataFrame:
    """(chunk_id, term): the last term of letters and digits of the first chunk, whose search has to find it."""
    first = sparse.where("fts_text is not null").groupBy().agg(F.min(F.struct("chunk_id", "fts_text")).alias("c"))
    good = F.filter(F.split("c.fts_text", r"\s+"), lambda t: t.rlike(r"^[\p{L}\p{N}]+$"))
    return first.where("c is not null").select("c.chunk_id", F.try_element_at(good, F.lit(-1)).alias("term"))


def _read(spark: SparkSession, path: str) -> dict | None:
    try:
        got = json.loads(files.read(spark, path)) if files.exists(spark, path) else None
    except ValueError:
        return None
    return got if isinstance(got, dict) else None


def write_json(path: str | Path, value: object) -> None:
    """Durable: written aside, flushed, then put in place at once."""
    files.write(_session(), str(path), json.dumps(value, ensure_ascii=False, sort_keys=True))


def seal(path: str | Path) -> int:
    """Flush every file and folder of a local build to the disk, from the bottom up; how many. Other file systems are durable once a write is closed."""
    home, n = _local(path), 0
    for folder, _, names in os.walk(home, topdown=False) if home else ():
        for name in [*(os.path.join(folder, x) for x in names), folder]:
            handle = os.open(name, os.O_RDONLY)
            try:
                os.fsync(handle)
                n += 1
            finally:
                os.close(handle)
    return n


def _state(spark: SparkSession, build: str, to: str, now: str, **more: object) -> None:
    have = _read(spark, f"{build}/generation.json")
    if have and to not in NEXT[have["state"]]:
        raise BuildError(f"a {have['state']} build can't become {to}")
    files.write(spark, f"{build}/generation.json", json.dumps({**(have or {}), "state": to, f"{to}_at": now, **more}, sort_keys=True))


def _records(spark: SparkSession, root: str) -> list[dict]:
    found = [_read(spark, f"{f}/generation.json") for f in files.folders(spark, root, "build_")]
    return [r for r in found if r]


def publish(sparse: DataFrame, dense: DataFrame, root: str, dim: int, now: str | None = None, work: dict[str, Callable[[dict], None]] | None = None, about: dict | None = None, wait: float = 0.0) -> str:
    """Write, reopen, validate and publish a build under ``root``; its id. A failed one leaves the pointer as it was.

    work: tasks by kind to be done after the commit; they are noted before it and, if they
    fail, tried again with the next build. about: what else the manifest says.
    """
    root, now = str(root), now or datetime.now(timezone.utc).isoformat()
    spark = sparse.sparkSession
    with lock(root, wait):
        reconcile(root, now)
        generation = max((r["generation"] for r in _records(spark, root)), default=0) + 1
        name = build_name()
        build = f"{root}/{name}"
        _state(spark, build, "building", now, generation=generation, build_id=name)
        try:
            sparse.write.mode("errorifexists").parquet(f"{build}/sparse_chunks")
            dense.write.mode("errorifexists").parquet(f"{build}/dense_chunks")
            bad = faults(spark.read.parquet(f"{build}/sparse_chunks"), spark.read.parquet(f"{build}/dense_chunks"), dim)
            if bad:
                raise BuildError("; ".join(bad))
            seal(build)
            manifest = {"format": FORMAT, "layout": LAYOUT, "generation": generation, "build_id": name, "dim": dim, "built_at": now, **(about or {})}
            files.write(spark, f"{build}/manifest.json", json.dumps(manifest, ensure_ascii=False, sort_keys=True))
            _state(spark, build, "validated", now, manifest=stable_hash(manifest))
            for kind in work or {}:
                journal.prepare(spark, root, kind, name, generation)
        except Exception as e:
            _state(spark, build, "failed", now, reason=f"{type(e).__name__}: {e}")
            raise
        old = pointer(root)
        files.write(spark, f"{root}/active.json", json.dumps({"format": FORMAT, "build_id": name, "generation": generation, "manifest": stable_hash(manifest)}))
        _state(spark, build, "published", now)
        if old:
            _state(spark, f"{root}/{old['build_id']}", "superseded", now)
    if work:
        journal.retry(spark, root, generation, work)
    return name


def pointer(root: str) -> dict | None:
    """The published build: by the pointer if it fits its build's manifest, else the newest build that was published and does."""
    spark = _session()

    def good(p: dict | None) -> bool:
        manifest = _read(spark, f"{root}/{p.get('build_id', '?')}/manifest.json") if p else None
        return bool(manifest) and p.get("format") == FORMAT and stable_hash(manifest) == p.get("manifest")

    p = _read(spark, f"{root}/active.json")
    if good(p):
        return p
    found = [{"format": FORMAT, "build_id": r["build_id"], "generation": r["generation"], "manifest": r.get("manifest")} for r in _records(spark, str(root)) if r["state"] in ("published", "superseded")]
    return max((p for p in found if good(p)), key=lambda p: p["generation"], default=None)


def reconcile(root: str, now: str | None = None) -> list[str]:
    """Bring the states of builds in line with the pointer after a crash: the pointed one is published, others that were are superseded, unfinished ones failed; the builds changed."""
    spark, now = _session(), now or datetime.now(timezone.utc).isoformat()
    p, changed = pointer(root), []
    for r in _records(spark, str(root)):
        own = p is not None and r["build_id"] == p["build_id"]
        to = "published" if own and r["state"] in ("validated", "superseded") else "superseded" if not own and r["state"] == "published" else "failed" if not own and r["state"] in ("building", "validated") else None
        if to:
            _state(spark, f"{root}/{r['build_id']}", to, now)
            changed.append(r["build_id"])
    return changed


def load(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Sparse and dense chunks of the published build."""
    p = pointer(root)
    if p is None:
        raise BuildError("nothing is published")
    manifest = _read(spark, f"{root}/{p['build_id']}/manifest.json") or {}
    if manifest.get("layout") != LAYOUT:
        raise BuildError("another layout; rebuild")
    build = f"{root}/{p['build_id']}"
    return spark.read.parquet(f"{build}/sparse_chunks"), spark.read.parquet(f"{build}/dense_chunks")


def stats(spark: SparkSession, root: str) -> dict[str, int]:
    """Rows of the published tables and chunks that have no vector in the index."""
    sparse, dense = load(spark, root)
    wanted = sparse.where("chunk_kind = 'dense'") if "chunk_kind" in sparse.columns else dense
    return {"sparse": sparse.count(), "dense": dense.count(), "unindexed": wanted.join(dense, "chunk_id", "left_anti").count()}
