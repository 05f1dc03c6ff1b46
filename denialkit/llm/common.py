"""Shared helpers of the training-data operators: durable cuts, columns, and table access."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, through Spark's reader only (the path may be any Hadoop store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; only where that is
    unset and Spark runs in one process (local tests) a temporary folder of our own."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="denialkit-")
        sc.setCheckpointDir(where)
        where = sc.getCheckpointDir()
    return where.rstrip("/")


class Stored:
    """Parquet tables in the shared folder that cut lineage; ``drop`` deletes what is done with.

    Written tables survive the loss of any executor. Those which a returned frame still reads
    stay, as Spark's own checkpoint files do.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths, self.made = spark, f"{shared_dir(spark)}/tables-{uuid.uuid4().hex}", {}, 0

    def put(self, name: str, df: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.root}/{self.made}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop(name))
            path.getFileSystem(conf).delete(path, True)


def ascii_lower(text):
    """Lower-case A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(doc_id, n: int):
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def attach(rows: DataFrame, groups: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Left join of rows with one row per group, whatever the group sizes.

    Groups of at least ``max(1000, total / 1000)`` rows number 1000 at most, so they are broadcast
    and their rows stay where they are; only rows of smaller groups shuffle.
    """
    limit = max(1000, total // 1000)
    heavy = F.broadcast(groups.where(F.col(size) >= limit))
    light = groups.where(F.col(size) < limit)
    return rows.join(heavy, key).unionByName(rows.join(heavy.select(key), key, "left_anti").join(light, key, "left"))


def labelled(docs: DataFrame, labels: DataFrame, label: str, fold: int, held_out: int, most: int) -> tuple[DataFrame, dict[int, int]]:
    """A bounded sample of labelled training documents, and the training rows of each label.

    Training rows have a 0/1 label and crc32(doc_id) mod ``fold`` other than ``held_out``; of a
    doc_id labelled twice the larger label counts. Of each label the ``most`` documents with the
    smallest hash of their id are taken, so the choice is stable; of rows that share such an id
    the smallest text counts.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (crc_mod(F.col("doc_id"), fold) != held_out))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    part = [known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for y in (0, 1)]
    chosen = F.broadcast(part[0].union(part[1]))  # 2 * most rows at most
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))
    return Stored(docs.sparkSession).put("sample", rows), counts


#: The most ids that are broadcast to drop or fetch documents; beyond that they shuffle.
SMALL = 500_000


def without(docs: DataFrame, ids: DataFrame, *extra: str, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The documents whose key columns (doc_id and ``extra``, or ``keys``) are not among ``ids``, a
    stored table; nulls equal each other."""
    keys, own = (*keys, *extra), uuid.uuid4().hex  # no column of docs has such a name
    ids = ids.select(*[F.col(k).alias(f"{k}_{own}") for k in keys])
    on = F.col(keys[0]).eqNullSafe(F.col(f"{keys[0]}_{own}"))
    for k in keys[1:]:
        on = on & (F.col(k) == F.col(f"{k}_{own}"))
    return docs.join(F.broadcast(ids) if ids.count() <= SMALL else ids, on, "left_anti")
