"""Study state files (A58, B19, I90-I93, J4-J6) and tables replaced by part."""

from __future__ import annotations

import json
from datetime import date, timedelta
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TARGET = 7
STATUSES = ("learning", "known")
STUDY = "word string, status string, study_count int, last_seen string, due_date string"


def clamp(value) -> int:
    """A count from 0 to the target; anything else is 0."""
    try:
        return max(0, min(TARGET, int(float(value))))
    except (TypeError, ValueError):
        return 0


def day_after(value: str | None, days: int = 1) -> str:
    """A date in days from `value`, or from today if that is none."""
    try:
        base = date.fromisoformat(value or "")
    except ValueError:
        base = date.today()
    return (base + timedelta(days=days)).isoformat()


def read_study(spark: SparkSession, path: str) -> DataFrame:
    """A state file as rows; an unreadable one has none. Unknown statuses and counts of 0 are left out."""
    try:
        raw = json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        raw = {}
    raw = raw if isinstance(raw, dict) else {}
    get = lambda k: raw.get(k) if isinstance(raw.get(k), dict) else {}
    counts = {w: n for w, v in get("study_counts").items() if (n := clamp(v))}
    status = {w: s for w, s in get("statuses").items() if s in STATUSES}
    times = {w: v for w, v in get("study_schedule").items() if isinstance(v, dict)}
    rows = []
    for w in sorted({*counts, *status, *times}):
        n = counts.get(w, 0)
        s = status.get(w) or ("known" if n >= TARGET else "learning" if n else None)
        rows.append((w, s, TARGET if s == "known" else n, times.get(w, {}).get("last_seen"), None if s == "known" else times.get(w, {}).get("due_date")))
    return spark.createDataFrame(rows, STUDY)


def write_study(rows: DataFrame, path: str) -> None:
    """The state of one learner as a file, replaced at once."""
    out: dict = {"statuses": {}, "study_counts": {}, "study_schedule": {}}
    for r in rows.toLocalIterator():
        if r["status"] in STATUSES:
            out["statuses"][r["word"]] = r["status"]
        if r["study_count"]:
            out["study_counts"][r["word"]] = r["study_count"]
        if r["due_date"]:
            out["study_schedule"][r["word"]] = {"last_seen": r["last_seen"], "due_date": r["due_date"]}
    new = Path(path + ".new")
    new.write_text(json.dumps(out, ensure_ascii=False, sort_keys=True), "utf-8")
    new.replace(path)


def replace_part(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of `new`, and those of `old` whose key it lacks."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def without(rows: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Rows but for those whose keys are listed."""
    return rows.join(gone.select(*keys).distinct(), keys, "left_anti")


def deletions(asked: DataFrame, have: DataFrame, key: str) -> DataFrame:
    """Each key asked for, with whether it was there."""
    return asked.select(key).distinct().join(have.select(key).distinct().withColumn("_h", F.lit(True)), key, "left").select(key, F.coalesce("_h", F.lit(False)).alias("deleted"))
