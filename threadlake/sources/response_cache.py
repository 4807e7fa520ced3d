"""The response cache (S12, L1): a frozen base and a log of appended parts, merged when read.

An append writes a part and names it in a new version; the last record of a key wins, parts in the order of their commits, the base before all. Compaction writes the merged records
as the new base. A read-only cache holds what is put into it in memory, on top, and writes nothing.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.operators.records import cache_lookup, cache_misses, latest_per_key
from threadlake.sources.files import CACHE, CACHE_REQUIRED, read_jsonl
from threadlake.sources.versions import VersionLog


class CacheMiss(LookupError):
    """A call that no record answers, where no call may be made."""


class ResponseCache:
    """Records of the ``CACHE`` schema by ``key`` below ``root``."""

    def __init__(self, spark: SparkSession, root: str, read_only: bool = False):
        self.spark, self.root, self.read_only = spark, root.rstrip("/"), read_only
        self.log = VersionLog(spark, root)
        self.overlay: list[DataFrame] = []

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        rows.write.option("compression", "gzip").json(f"{self.root}/{name}")
        return name

    def put(self, rows: DataFrame) -> None:
        """Add records; of rows that repeat a key the last one counts."""
        rows = rows.select(*CACHE_REQUIRED, F.monotonically_increasing_id().alias("seq"))
        if self.read_only:
            self.overlay.append(rows)
            return
        version, facts = self.log.latest()
        self.log.commit(version + 1, {"base": facts.get("base"), "parts": [*facts.get("parts", []), self._write(rows, "part")]})

    def adopt(self, path: str) -> None:
        """Add the records of a JSON-lines log of others; torn lines are left out."""
        self.put(read_jsonl(self.spark, path, CACHE, CACHE_REQUIRED))

    def read(self) -> DataFrame:
        """The last record of each key; aggregated map-side, so that a key that is written often costs a row a task."""
        _, facts = self.log.latest()
        names = [n for n in (facts.get("base"), *facts.get("parts", [])) if n]
        held = [read_jsonl(self.spark, f"{self.root}/{n}", f"{CACHE}, seq long", CACHE_REQUIRED) for n in names] + self.overlay
        every = self.spark.createDataFrame([], f"{CACHE}, seq long, nth int")
        for nth, rows in enumerate(held):
            every = every.unionByName(rows.withColumn("nth", F.lit(nth)))
        return latest_per_key(every.withColumn("_at", F.struct("nth", "seq")).drop("nth", "seq"), "key", "_at").select(*CACHE_REQUIRED)

    def compact(self) -> None:
        """Merge base and parts into a new base; files of the version before the last go."""
        if self.read_only:
            raise PermissionError("a read-only cache isn't written")
        version, facts = self.log.latest()
        base = self._write(self.read().withColumn("seq", F.lit(0).cast("long")), "base")
        self.log.commit(version + 1, {"base": base, "parts": [], "gone": [n for n in (facts.get("base"), *facts.get("parts", [])) if n]})
        self.log.drop(facts.get("gone", []))

    def lookup(self, calls: DataFrame) -> DataFrame:
        """The first cached answer of each call along its chain."""
        return cache_lookup(calls, self.read())

    def require(self, calls: DataFrame) -> DataFrame:
        """``lookup`` where nothing may be asked: raises ``CacheMiss``, with a few of the calls, if any has no answer."""
        missing = [r["call_id"] for r in cache_misses(calls, self.read()).select("call_id").orderBy("call_id").limit(5).collect()]
        if missing:
            raise CacheMiss(f"no cached answer for calls {missing}")
        return self.lookup(calls)
