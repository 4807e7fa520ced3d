"""An extension: the latest record per key over a stream of log records, and tumbling counts with a watermark."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from threadlake.operators.records import latest_per_key
from threadlake.sources.versions import VersionLog


class LatestTable:
    """A table of the latest record per key in the shared folder, in buckets by the key's hash.

    A micro-batch rewrites the buckets that its keys fall in, and no others (copy on write); a version then names every bucket's folder and the epoch, so that a batch that is run again
    after a failure changes nothing, and readers see whole batches only. Epochs go on from the stream's checkpoint after a restart. Folders that neither the last version nor the one before names are deleted.
    """

    def __init__(self, path: str, schema: str, key: str, seq: str, buckets: int = 64):
        self.path, self.schema, self.key, self.seq, self.buckets = path.rstrip("/"), schema, key, seq, buckets

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def _folders(self, spark, folders: list[str]) -> DataFrame:
        parts = [spark.read.schema(self.schema).parquet(f"{self.path}/{f}") for f in folders]
        return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], self.schema)

    def read(self, spark) -> DataFrame:
        _, facts = VersionLog(spark, self.path).latest()
        return self._folders(spark, sorted(facts.get("buckets", {}).values()))

    def upsert(self, batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        log = VersionLog(spark, self.path)
        version, facts = log.latest()
        if epoch <= facts.get("epoch", -1):
            return
        now = facts.get("buckets", {})
        touched = [str(r[0]) for r in batch.select(self._bucket()).distinct().collect()]  # as many as there are buckets at most
        every = self._folders(spark, [now[b] for b in touched if b in now]).unionByName(batch.select(*self._folders(spark, []).columns))
        made = f"e{epoch}-{uuid.uuid4().hex}"
        merged = latest_per_key(every, self.key, self.seq).withColumn("_bucket", self._bucket())
        merged.repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/{made}")
        new = now | {b: f"{made}/_bucket={b}" for b in touched}
        gone = [f for b, f in now.items() if new[b] != f]
        log.commit(version + 1, {"epoch": epoch, "buckets": new, "gone": gone})
        log.drop(facts.get("gone", []))

    def start(self, stream: DataFrame, checkpoint: str):
        return stream.writeStream.foreachBatch(self.upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts_col: str, key: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(ts_col, late).groupBy(F.window(ts_col, width).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
