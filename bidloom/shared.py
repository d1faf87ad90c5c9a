"""What jobs of several steps share: the common folder, tables written in it, hot-key joins, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table up to which ``join_counted`` lets Spark send it to all tasks.
SENT = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one only where the session names none and runs on one machine."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = getattr(spark, "_bidloom_shared", None) or f"file://{tempfile.mkdtemp(prefix='bidloom-')}"
        spark._bidloom_shared = at
    return at.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder; ``clear`` knows it."""
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not hasattr(spark, "_bidloom_scratch"):
        spark._bidloom_scratch = []
    spark._bidloom_scratch.append(at)
    return at


def delete(spark: SparkSession, at: str) -> bool:
    """Deletes a path in whatever store it lies; false if there was none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def clear(spark: SparkSession) -> int:
    """Deletes the folders that this session's operators have written; their number. Results that read them must be written before."""
    made, spark._bidloom_scratch = getattr(spark, "_bidloom_scratch", []), []
    for at in made:
        delete(spark, at)
    return len(made)


def unused(names: list[str], wanted: str) -> str:
    """A column name that is not among ``names`` in any case."""
    taken = {n.lower() for n in names}
    return next(n for n in (wanted + "_" * k for k in range(len(names) + 1)) if n.lower() not in taken)


def cut(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here."""
    spark, at = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(at, compression=compression)
    out = spark.read.schema(df.schema).parquet(at)
    out._bidloom_at = at
    return out


def drop(held: DataFrame) -> None:
    """Deletes the folder of a table that ``cut`` gave and that nothing reads any more."""
    spark, at = held.sparkSession, held._bidloom_at
    delete(spark, at)
    spark._bidloom_scratch.remove(at)


def join_counted(rows: DataFrame, table: DataFrame, key: str, n: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has one row a ``key`` and in ``n`` how many of ``rows`` hold it.

    Keys that hold over a thousandth of all counted rows are fewer than a thousand: they are broadcast, and their rows are not shuffled.
    All others go through a shuffle, in which no key has more than a thousandth of the rows; only a table of up to ``SENT`` rows may be sent
    whole, as its files weigh a small part of what its rows take in memory and the driver. ``how``: inner or left.
    """
    total, size = table.agg(F.coalesce(F.sum(n), F.lit(0)).cast("long"), F.count("*")).first()
    hot, mark = F.col(n) * 1000 > total, unused([*rows.columns, *table.columns], "hot")
    keys = table.where(hot).select(key, F.lit(True).alias(mark))
    rows = rows.join(F.broadcast(keys), key, "left")
    near = rows.where(mark).drop(mark).join(F.broadcast(table.where(hot)), key)
    far = table.where(~hot) if size <= SENT else table.where(~hot).hint("merge")
    return near.unionByName(rows.where(F.col(mark).isNull()).drop(mark).join(far, key, how))


def dealt(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` in a stated number of partitions: rows of few bytes but much work would else be read by one task, as a small file is one piece."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)


def by_content(rows: DataFrame, columns: list[str], work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` with the columns that ``work`` adds to a table of the distinct values of ``columns``, nulls among them: equal contents are worked out once.

    The contents are dealt out; rows find theirs by ``join_counted``. ``rows`` is read three times."""
    key, n = unused([*rows.columns, *columns], "content"), unused([*rows.columns, *columns], "rows_of_content")
    held = cut(rows.groupBy(*columns).agg(F.count("*").alias(n)), "contents")
    made = work(dealt(held, *columns))
    added = [c for c in made.columns if c not in held.columns]
    table = cut(made.select(F.struct(*columns).alias(key), n, *added), "worked")
    return join_counted(rows.withColumn(key, F.struct(*columns)), table, key, n).drop(key, n)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges (a, b)``: ``(node, root)`` with the least node as root.

    Alternates large-star and small-star joins until the edge set is a forest of stars on the
    least node. A round is two aggregations and two joins over written tables; a hub's rows meet their one
    row of the aggregate by ``join_counted``, so that no task gets a hub whole. Only counts and sums reach the driver.
    A root gives no row of its own, and nodes without an edge do not appear. An empty input gives an empty result.
    """
    cur = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        # Large star: every neighbour above a node is linked to the node's least neighbour.
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = cut(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")), "low")
        large = join_counted(both, low, "u", "n").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = cut(large, "large")
        # Small star: every neighbour below a node, and the node, are linked to the least of them.
        low = cut(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "low")
        small = join_counted(large, low, "u", "n").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        cur = cut(small, "small")
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
