"""A keyed table that a stream writes exactly once.

``Store.merge`` is made for ``foreachBatch``: the rows of a batch go to a folder named by the batch's number, so a batch that is
replayed after a failure finds its folder complete and writes nothing, or writes it anew where it was cut short. ``read`` takes
of each key the row that is last by ``order`` and, where that ties or there is none, by batch; a row whose ``op`` is
``delete`` removes its key. ``compact`` writes what ``read`` gives as a new base; batches up to it are then
done with, and a replay of one of them is ignored. The base before stays for readers that have begun on it, and goes with the next compaction.

A store has one writing query. Folders lie wherever Spark writes; ``_SUCCESS``, which Spark's committer writes last, tells complete ones.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidloom import shared


class Store:
    def __init__(self, spark: SparkSession, at: str, schema: str | T.StructType, keys: tuple[str, ...], order: tuple[str, ...] = ()):
        """``schema``: the columns of rows, without ``op``; ``keys`` and ``order`` are among them."""
        self.spark, self.at, self.keys, self.order = spark, at.rstrip("/"), tuple(keys), tuple(order)
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _complete(self, kind: str) -> list[int]:
        """The numbers of complete batches or bases."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{kind}")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(path)]
        success = lambda n: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{kind}/{n}/_SUCCESS"))
        return sorted(int(n[2:]) for n in names if re.fullmatch(r"n=\d+", n) and success(n))

    def base(self) -> int | None:
        return max(self._complete("base"), default=None)

    def batches(self) -> list[int]:
        """The complete batches after the base."""
        base = self.base()
        return [n for n in self._complete("batch") if base is None or n > base]

    def _newest(self, rows: DataFrame, *last: Column) -> DataFrame:
        """One row a key: the last by ``order``, then by ``last``, then by its other columns, so that a replay chooses alike."""
        rest = [c for c in rows.columns if c not in self.keys]
        top = F.max_by(F.struct(*rest), F.struct(*self.order, *last, F.xxhash64(*rest))).alias("row")
        return rows.groupBy(*self.keys).agg(top).select(*self.keys, "row.*")

    def merge(self, rows: DataFrame, batch: int) -> bool:
        """Writes a batch, of each key its last row; false if it was written before. ``op`` may be missing; only ``delete`` means anything."""
        base = self.base()
        if (base is not None and batch <= base) or batch in self._complete("batch"):
            return False
        op = F.coalesce("op", F.lit("upsert")) if "op" in rows.columns else F.lit("upsert")
        own = rows.select(*[F.col(f.name).cast(f.dataType) for f in self.schema.fields], op.alias("op"))
        self._newest(own).write.mode("overwrite").parquet(f"{self.at}/batch/n={batch}")
        return True

    def _held(self) -> DataFrame:
        schema = T.StructType([*self.schema.fields, T.StructField("op", T.StringType())])
        base, parts = self.base(), []
        if base is not None:
            parts.append((base, f"{self.at}/base/n={base}"))
        parts += [(n, f"{self.at}/batch/n={n}") for n in self.batches()]
        if not parts:
            return self.spark.createDataFrame([], schema).withColumn("n", F.lit(0).cast("long"))
        paths = [p for _, p in parts]
        name = F.regexp_extract(F.col("_metadata.file_path"), r"/n=(\d+)/", 1)
        return self.spark.read.schema(schema).parquet(*paths).withColumn("n", name.cast("long"))

    def read(self) -> DataFrame:
        """The rows that hold now. Deleted keys that are younger than the base are left out here, not stored away."""
        return self._newest(self._held(), F.col("n")).where("op <> 'delete'").select(*self.schema.names)

    def compact(self, keep_deleted: bool = True) -> int | None:
        """Writes a new base of all complete batches; its number, or none where there is nothing new. ``keep_deleted``: deleted keys
        stay marked, so that a later batch with an earlier row does not bring them back; without an ``order`` there is none."""
        new = self.batches()
        if not new:
            return None
        before = self.base()
        rows = self._newest(self._held(), F.col("n")).drop("n")
        rows = rows if keep_deleted and self.order else rows.where("op <> 'delete'")
        rows.write.mode("overwrite").parquet(f"{self.at}/base/n={new[-1]}")
        for n in self._complete("base"):
            if before is None or n < before:
                if n != new[-1]:
                    shared.delete(self.spark, f"{self.at}/base/n={n}")
        for n in self._complete("batch"):
            if before is not None and n <= before:
                shared.delete(self.spark, f"{self.at}/batch/n={n}")
        return new[-1]

    def write(self, stream: DataFrame, checkpoint: str, compact_every: int = 0, **trigger) -> object:
        """Starts a query that merges each batch of ``stream``, and compacts after every so many."""

        def one(rows: DataFrame, batch: int) -> None:
            self.merge(rows, batch)
            if compact_every and batch and batch % compact_every == 0:
                self.compact()

        return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
