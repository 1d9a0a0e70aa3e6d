"""Cutting lineage, sized broadcasts and the crc fold, shared by the operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one or two longs that may be broadcast after they were counted; more rows are joined by a shuffle.
BROADCAST_ROWS = 200_000

#: Bytes of an Arrow batch on its way to a Python worker. JVM and worker hold it at once, each in its own memory.
BATCH_BYTES = 4 << 20

#: A value is hot if it holds one in HOT_SHARE of all rows: there are at most so many.
HOT_SHARE = 5_000


def shared_root(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where that is unset and Spark is local."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not root:
        made = spark.sparkContext._jsc.sc().getCheckpointDir()
        if made.isDefined():
            return made.get()
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        root = "file://" + tempfile.mkdtemp(prefix="snapweave-")
        spark.sparkContext.setCheckpointDir(root)
    return root


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a written table, shared by driver and executors."""
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    """df computed once and cut from its lineage, in the shared folder.

    Its files go with the frame only where spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: a third of a checkpoint's size for long tables."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs within it sends batches of BATCH_BYTES to Python workers, where the session sets no size itself."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(name, None) is not None:
        yield
        return
    spark.conf.set(name, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(name)


def maybe_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df with a broadcast hint if it was counted to be within BROADCAST_ROWS, else as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


def join_counted(rows: DataFrame, counted: DataFrame, on: str) -> DataFrame:
    """rows.join(counted, on), where counted has one row per value of `on` and its number of rows, `times`.

    counted should be computed already. Values that hold a HOT_SHARE-th of its rows or more, of which
    there are at most HOT_SHARE, are broadcast, so that the rows of a hot value stay in their tasks;
    all other values are joined by a shuffle.
    """
    total = counted.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    least = max(total // HOT_SHARE, 100)
    hot = F.broadcast(counted.filter(F.col("times") >= least))
    cold = rows.join(hot.select(on), on, "left_anti").join(counted.filter(F.col("times") < least), on)
    return cold.unionByName(rows.join(hot, on))


def bounded(df: DataFrame, by: list[str], most: int, total: int) -> DataFrame:
    """The `most` rows that are least by a hash of `by`.

    A threshold on the hash first leaves about 1.5 times as many, so that not every task sends `most`.
    """
    h = F.xxhash64(*by)
    if total > 2 * most:
        df = df.filter(F.pmod(h, F.lit(1 << 31)) < int((1 << 31) * 1.5 * most / total))
    return df.orderBy(F.pmod(h, F.lit(1 << 31)), *by).limit(most)


def drop_ids(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rows whose key is in ids (one column of that name); null keys stay."""
    ids = checkpoint(ids.select(F.col(key).alias(key)).distinct())
    return docs.join(maybe_broadcast(ids), key, "left_anti").select(*docs.columns)


def fold(key: str, n: int) -> F.Column:
    """crc32 of the key as text, modulo n; null keys have fold 0."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % n, F.lit(0)).cast("int")


def unused(df: DataFrame, name: str) -> str:
    """The name, with underscores after it until df has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of links (u, v): rows (node, component), the least node of each.

    Rounds of "take the least label among the neighbours, then jump to the label's label", each
    checkpointed; a path of n nodes takes about log n rounds. Only nodes with a link are returned.
    """
    both = checkpoint(
        links.select("u", "v").union(links.select(F.col("v"), F.col("u"))).filter("u <> v").distinct()
    )
    labels = checkpoint(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")))
    nodes = labels.count()
    for _ in range(max_rounds):
        near = (
            both.join(maybe_broadcast(labels, nodes), both.v == labels.node)
            .groupBy(F.col("u").alias("node"))
            .agg(F.min("label").alias("near"))
        )
        step = maybe_broadcast(labels, nodes).join(near, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        jump = maybe_broadcast(labels.select(F.col("node").alias("label"), F.col("label").alias("far")), nodes)
        step = checkpoint(
            step.join(jump, "label", "left").select(
                "node", "old", F.least("label", F.coalesce("far", "label")).alias("label")
            )
        )
        labels = step.select("node", "label")
        if step.filter("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
