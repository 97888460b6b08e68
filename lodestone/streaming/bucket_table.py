"""A keyed table in hash buckets that streams write: data first, then a manifest that names what is live."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.sources.readers import remove


class BucketTable:
    """Rows of ``schema`` under ``path``, dealt into ``buckets`` by a hash of ``key``.

    A commit writes the touched buckets to a folder of its own and then a manifest, numbered one higher
    than the last, which names the live folders of every bucket and the last batch of every stream.  A
    manifest is never overwritten: who finds its number taken starts again from the newer one.  Until the
    manifest is there, nothing has changed; a batch that runs again after it is recognised and left out,
    whatever checkpoint other streams have.  What neither of the last two manifests names is deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: str, buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets
        self._paths = spark._jvm.org.apache.hadoop.fs.Path  # noqa: SLF001 - the file system behind any Spark path
        self._files = self._paths(self.path).getFileSystem(spark._jsc.hadoopConfiguration())  # noqa: SLF001

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int").alias("b")

    def _manifests(self) -> list[int]:
        place = self._paths(f"{self.path}/log")
        return sorted(int(s.getPath().getName()[:-5]) for s in self._files.listStatus(place) if s.getPath().getName().endswith(".json")) if self._files.exists(place) else []

    def _manifest(self, number: int) -> dict:
        stream = self._files.open(self._paths(f"{self.path}/log/{number:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def state(self) -> dict:
        """{number, live: bucket -> folders, streams: stream -> last batch}."""
        found = self._manifests()
        return self._manifest(found[-1]) if found else {"number": -1, "live": {}, "streams": {}}

    def _publish(self, manifest: dict) -> bool:
        """Write a manifest whole or not at all; False if another writer has that number."""
        target = self._paths(f"{self.path}/log/{manifest['number']:012d}.json")
        drafted = self._paths(f"{self.path}/log/.{uuid.uuid4().hex}")
        stream = self._files.create(drafted, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        if not self._files.exists(target) and self._files.rename(drafted, target):
            return True
        self._files.delete(drafted, False)
        return False

    def rows(self, state: dict | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The live rows of all or some buckets."""
        state = state or self.state()
        wanted = [f"{self.path}/data/{folder}/b={b}" for b, folders in state["live"].items() for folder in folders if buckets is None or int(b) in buckets]
        return self.spark.read.schema(self.schema).parquet(*wanted) if wanted else self.spark.createDataFrame([], self.schema)

    def commit(self, stream: str, batch: int, fresh: DataFrame, make: Callable[[DataFrame, DataFrame], DataFrame], replace: bool) -> bool:
        """Bring ``fresh`` (rows and b) in as batch ``batch`` of ``stream``; False if that has been done before.

        ``make(fresh, old)`` gives the rows to write from the new rows and those that the touched buckets
        hold; they take the place of the old ones (``replace``) or join them.
        """
        touched = [r["b"] for r in fresh.select("b").distinct().collect()]  # at most ``buckets`` numbers
        while True:
            state = self.state()
            if state["streams"].get(stream, -1) >= batch:
                return False
            folder = f"{state['number'] + 1:012d}-{uuid.uuid4().hex[:12]}"
            live = dict(state["live"])
            if touched:
                made = make(fresh, self.rows(state, touched))
                made.withColumn("b", self.bucket()).repartition("b").write.partitionBy("b").parquet(f"{self.path}/data/{folder}")
                wrote = {b for b in touched if self._files.exists(self._paths(f"{self.path}/data/{folder}/b={b}"))}
                for b in wrote:
                    live[str(b)] = [folder] if replace else [*live.get(str(b), []), folder]
            if self._publish({"number": state["number"] + 1, "live": live, "streams": {**state["streams"], stream: batch}}):
                self._tidy()
                return True
            remove(self.spark, f"{self.path}/data/{folder}")

    def _tidy(self) -> None:
        """Delete folders of buckets that were live two manifests ago and are no more, and the manifests before them."""
        found = self._manifests()
        if len(found) < 3:
            return
        old, kept = self._manifest(found[-3]), [self._manifest(n) for n in found[-2:]]
        for b, folders in old["live"].items():
            for folder in set(folders).difference(*(m["live"].get(b, []) for m in kept)):
                remove(self.spark, f"{self.path}/data/{folder}/b={b}")
        for number in found[:-2]:
            self._files.delete(self._paths(f"{self.path}/log/{number:012d}.json"), False)
