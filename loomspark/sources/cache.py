"""Results by content key, kept in shared storage: lookups by join, one folder per write, eviction of the oldest, counters.

Entries stand as Parquet below `entries`, keys that were evicted below `evicted`; the newest entry of a key counts. No texts, trees
or secrets are stored: rows are projected to the columns of findings first.
"""

from __future__ import annotations

import json
import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.operators import ranking

# What is kept of a finding.
KEPT = {"source": "string", "rule_id": "string", "severity": "string", "category": "string", "title": "string", "message": "string", "rel_path": "string", "line_start": "int", "column_start": "int", "line_end": "int", "column_end": "int", "suggestion": "string", "fixable": "boolean", "confidence": "double"}
_FINDING = "struct<" + ",".join(f"{k}:{v}" for k, v in KEPT.items()) + ">"
ENTRY = f"key string, cached_at timestamp, findings array<{_FINDING}>"


def stable(options: object) -> str:
    """JSON with the keys of every object in order and no blanks."""
    return json.dumps(options, sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def review_key(source: Column, path: Column, scope: Column, version: str, options: dict) -> Column:
    """Hash of a text's hash, its path, the changed ranges (array of start, end; in any order), the version and the options."""
    return F.sha2(F.to_json(F.struct(F.sha2(source, 256).alias("sha"), path.alias("path"), F.array_sort(F.coalesce(scope, F.array().cast("array<struct<start:int,end:int>>"))).alias("scope"), F.lit(version).alias("version"), F.lit(stable(options)).alias("options"))), 256)


def projected(findings: DataFrame) -> DataFrame:
    """key and the finding as a struct of KEPT; an empty suggestion is null, and fixable never is."""
    c = {n: (F.col(n) if n in findings.columns else F.lit(None)).cast(t) for n, t in KEPT.items()}
    c["suggestion"], c["fixable"] = F.nullif(c["suggestion"], F.lit("")), F.coalesce(c["fixable"], F.lit(False))
    return findings.select("key", F.struct(*[v.alias(n) for n, v in c.items()]).alias("finding"))


class Cache:
    """One writer at a time. path: a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, *, max_entries: int = 1000, enabled: bool = True):
        self.spark, self.path, self.max_entries, self.enabled = spark, path.rstrip("/"), max_entries, enabled
        self.counts = dict.fromkeys(("hits", "misses", "writes", "evictions", "invalid"), 0)

    def _there(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return (fs, p) if fs.exists(p) else None

    def _read(self, name: str, schema: str) -> DataFrame:
        at = f"{self.path}/{name}"
        return self.spark.read.schema(schema).parquet(at) if self._there(at) else self.spark.createDataFrame([], schema)

    def entries(self) -> DataFrame:
        """The newest entry of each key, without those evicted since."""
        newest = self._read("entries", ENTRY).groupBy("key").agg(F.max_by(F.struct("cached_at", "findings"), "cached_at").alias("x")).select("key", "x.*")
        gone = self._read("evicted", "key string, cached_at timestamp").distinct()
        return newest.join(gone, ["key", "cached_at"], "left_anti")

    def lookup(self, keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(hits, misses) of rows with a key: hits carry their stored findings, misses are the work to do. Entries without findings are invalid and miss."""
        if not self.enabled:
            return keyed.withColumn("findings", F.lit(None).cast(f"array<{_FINDING}>")).where("false"), keyed
        both = keyed.join(self.entries().select("key", "findings", F.lit(True).alias("_known")), "key", "left")
        valid = F.col("findings").isNotNull()
        n = both.agg(F.count_if(valid).alias("hits"), F.count_if(~valid).alias("misses"), F.count_if(F.col("_known") & ~valid).alias("invalid")).first()
        for k in ("hits", "misses", "invalid"):
            self.counts[k] += n[k]
        return both.where(valid).drop("_known"), both.where(~valid).drop("_known", "findings")

    def put(self, keys: DataFrame, findings: DataFrame) -> bool:
        """Stores what was found for each key (findings have a key), also where that is nothing, then evicts. A failed write is no error: False."""
        if not self.enabled:
            return False
        listed = projected(findings).groupBy("key").agg(F.array_sort(F.collect_list("finding")).alias("found"))
        rows = keys.where("key is not null").select("key").distinct().join(listed, "key", "left")
        rows = rows.select("key", F.current_timestamp().alias("cached_at"), F.coalesce("found", F.array().cast(f"array<{_FINDING}>")).alias("findings"))
        try:
            rows.write.mode("append").parquet(f"{self.path}/entries")
        except Exception as e:  # a cache that cannot be written stops no review
            logging.getLogger(__name__).warning("not stored: %s", e)
            return False
        self.counts["writes"] += keys.where("key is not null").select("key").distinct().count()
        self.evict()
        return True

    def evict(self) -> int:
        """Marks the oldest entries beyond max_entries as gone (0: no limit)."""
        if not self.enabled or self.max_entries <= 0:
            return 0
        live = self.entries().select("key", "cached_at")
        over = live.count() - self.max_entries
        if over <= 0:
            return 0
        ranking.evicted(live, self.max_entries, "key", "cached_at").write.mode("append").parquet(f"{self.path}/evicted")
        self.counts["evictions"] += over
        return over

    def clear(self) -> int:
        """Removes all entries; returns how many there were."""
        n = self.entries().count()
        for name in ("entries", "evicted"):
            at = self._there(f"{self.path}/{name}")
            if at:
                at[0].delete(at[1], True)
        return n

    def statistics(self) -> dict:
        return {"enabled": self.enabled, **self.counts, "directory": self.path}
