"""User dictionaries: registry, index tables and lookup.

The registry is a small JSON file beside the index tables; entries lie in parquet tables by
dictionary, sorted by lookup key, so that a lookup prunes files by statistics.
"""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shiori.sources.lexicons import yomitan_rows

EACH, ENOUGH = 8, 24


class Dictionaries:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, Path(root)
        self.file = self.root / "registry.json"

    def all(self) -> list[dict]:
        """Records in lookup order: priority, then name. Records without id are left out."""
        if not self.file.exists():
            return []
        return sorted((r for r in json.loads(self.file.read_text("utf-8")) if r.get("id")), key=lambda r: (r["priority"], r["name"]))

    def _save(self, records: list[dict]) -> None:
        self.root.mkdir(parents=True, exist_ok=True)
        new = self.file.with_suffix(".new")
        new.write_text(json.dumps(records, ensure_ascii=False, indent=1), "utf-8")
        new.replace(self.file)

    def add(self, path: str, name: str, priority: int = 100) -> dict:
        """Imports an archive. The same content again is the same dictionary; one that failed is indexed anew."""
        raw = Path(path).read_bytes()
        digest = hashlib.sha256(raw).hexdigest()
        records = self.all()
        found = next((r for r in records if r["sha256"] == digest), None)
        if found and found["status"] == "ready":
            return found
        slug = re.sub(r"[^\w]+", "-", name.lower()).strip("-")[:60] or "dictionary"
        record = found or {"id": f"{slug}-{digest[:8]}", "name": name, "priority": priority, "enabled": True, "sha256": digest}
        try:
            files = self.spark.createDataFrame([(path, bytearray(raw))], "file string, content binary")
            rows = yomitan_rows(files, record["id"])
            rows.repartitionByRange(4, "lookup_key").sortWithinPartitions("lookup_key").write.mode("overwrite").parquet(str(self.root / record["id"]))
            n = self.spark.read.parquet(str(self.root / record["id"])).agg(F.count_distinct("entry_id").alias("e"), F.count_distinct("headword").alias("h"), F.count(F.lit(1)).alias("k")).first()
            record |= {"status": "ready", "entries": n["e"], "headwords": n["h"], "keys": n["k"], "error": None}
        except Exception as e:
            record |= {"status": "error", "error": str(e)[:300]}
        self._save([r for r in records if r["id"] != record["id"]] + [record])
        return record

    def update(self, key: str, **changes) -> dict:
        """Changes name, priority or enabled; an unknown id raises."""
        records = self.all()
        record = next((r for r in records if r["id"] == key), None)
        if record is None:
            raise KeyError(key)
        record |= {k: v for k, v in changes.items() if k in ("name", "priority", "enabled")}
        self._save(records)
        return record

    def remove(self, key: str) -> None:
        records = self.all()
        if all(r["id"] != key for r in records):
            raise KeyError(key)
        self._save([r for r in records if r["id"] != key])

    def lookup(self, wanted: DataFrame) -> DataFrame:
        """wanted (word, place, lookup_key) to (word, dict_id, entry_id, headword, content, rank).

        A key's entries by score; of a dictionary at most EACH entries of a word, and no
        further dictionary once those before it gave ENOUGH.
        """
        ready = [r for r in self.all() if r["enabled"] and r["status"] == "ready"]
        kind = "word string, dict_id string, entry_id long, headword string, content string, rank int"
        if not ready:
            return self.spark.createDataFrame([], kind)
        order = self.spark.createDataFrame([(r["id"], i) for i, r in enumerate(ready)], "dict_id string, at int")
        entries = self.spark.read.parquet(*(str(self.root / r["id"]) for r in ready))
        hits = wanted.join(entries, "lookup_key").join(F.broadcast(order), "dict_id")
        once = hits.groupBy("word", "dict_id", "at", "entry_id", "headword", "content").agg(F.min("place").alias("place"), F.max("score").alias("score"))
        top = once.withColumn("rank", F.row_number().over(Window.partitionBy("word", "dict_id").orderBy("place", F.desc("score"), "entry_id"))).where(F.col("rank") <= EACH)
        sizes = top.groupBy("word", "dict_id", "at").agg(F.count(F.lit(1)).alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("word").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        kept = sizes.withColumn("before", before).where(F.col("before") < ENOUGH).select("word", "dict_id")
        return top.join(kept, ["word", "dict_id"], "left_semi").select("word", "dict_id", "entry_id", "headword", "content", "rank")
