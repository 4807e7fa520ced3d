"""The embedding store (S11, M1): the vectors of an ordered set of texts under a digest of the set.

The digest takes in the model, the type of the numbers, how many texts there are and each text with its place, all summed up map-side, so that another order or model is another set.
A set's segment is written first and named by a version then; its checksum is held against the data whenever it is read. What is torn, corrupt or of another count is a miss, is made
again and replaced.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadlake.sources.versions import VersionLog

TYPES = ("float", "double")


def digest(rows: DataFrame, *cols: str) -> list[str]:
    """[count, two sums of hashes] over all rows, whatever their order."""
    one, two = F.xxhash64(*cols), F.xxhash64(F.lit(1), *cols)
    got = rows.agg(F.count("*").alias("n"), F.sum(one.cast("decimal(20,0)")).alias("a"), F.bit_xor(two).alias("b")).first()
    return [str(got["n"]), str(got["a"]), str(got["b"])]


class EmbeddingStore:
    """Vectors of sets of texts below ``root``, of one model and type."""

    def __init__(self, spark: SparkSession, root: str, model: str, dtype: str = "float"):
        if dtype not in TYPES:
            raise ValueError(f"{dtype} is none of {TYPES}")
        self.spark, self.root, self.model, self.dtype = spark, root.rstrip("/"), model, dtype

    def key(self, texts: DataFrame) -> str:
        """16 hex digits of the set (place, text)."""
        return hashlib.sha256("\0".join([self.model, self.dtype, *digest(texts, "place", "text")]).encode()).hexdigest()[:16]

    def _segment(self, path: str) -> DataFrame:
        return self.spark.read.schema(f"place long, embedding array<{self.dtype}>").parquet(path)

    def _held(self, root: str, facts: dict) -> DataFrame | None:
        if not facts:
            return None
        rows = self._segment(f"{root}/{facts['segment']}")
        try:
            whole = digest(rows, "place", "embedding") == facts["digest"]
        except (Py4JJavaError, PySparkException):  # files that are gone or can't be read
            whole = False
        return rows if whole else None

    def embed(self, texts: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """(place, embedding) of ``texts`` (place long, text): read from the store, or made by ``encode``, which adds ``embedding`` to the rows, and stored. Raises ValueError, and stores
        nothing, where it doesn't give one vector for each text. A null text counts as one."""
        texts = texts.select(F.col("place").cast("long").alias("place"), "text")
        root = f"{self.root}/{self.key(texts)}"
        log = VersionLog(self.spark, root)
        version, facts = log.latest()
        held = self._held(root, facts)
        if held is not None:
            return held
        segment = f"segment-{uuid.uuid4().hex}"
        encode(texts).select("place", F.col("embedding").cast(f"array<{self.dtype}>").alias("embedding")).write.parquet(f"{root}/{segment}")
        made = self._segment(f"{root}/{segment}")
        want = texts.count()
        got = made.agg(F.count("embedding").alias("n"), F.count("*").alias("rows"), F.countDistinct("place").alias("places")).first()
        if (got["n"], got["rows"], got["places"]) != (want,) * 3:
            log.drop([segment])
            raise ValueError(f"{got['n']} vectors for {want} texts")
        log.commit(version + 1, {"segment": segment, "digest": digest(made, "place", "embedding")})
        if facts:
            log.drop([facts["segment"]])
        return made
