"""Shared plumbing: shared-folder tables, table reading, Arrow helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is used, but only in local mode: on a cluster a
    machine-local folder would not be seen by other machines, so that is an error.
    """
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not (conf.get("spark.master") or "").startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="palimpsest-")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


class Scratch:
    """Parquet tables in the shared folder, used to cut lineage and to reuse results.

    They survive the loss of an executor. ``drop`` removes tables early, ``keep`` all but those that
    a result still reads; the rest go when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, what: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{what}-{uuid.uuid4().hex}"
        self.names: set[str] = set()
        self._fs().deleteOnExit(self._path(self.base))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _fs(self):
        return self._path(self.base).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and read it back."""
        self.names.add(name)
        df.write.mode("overwrite").parquet(self.path(name))
        return self.read(df.schema, name)

    def read(self, schema, name: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._fs().delete(self._path(self.path(name)), True)
            self.names.discard(name)

    def keep(self, *names: str) -> None:
        """Drop every table written here but these."""
        self.drop(*(self.names - set(names)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of a table of documents; whatever else it has is left behind."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Ids that are broadcast at most (each a row of some 100 bytes with its key); more go through a shuffle.
BROADCAST_IDS = 200_000


def numbered(docs: DataFrame, scratch: Scratch) -> tuple[DataFrame, str]:
    """docs with a row number in a column of a name that it doesn't have. Written, so that numbers last."""
    name = "_row"
    while name in docs.columns:
        name += "_"
    return scratch.table(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def digest(*cols: Column) -> Column:
    """SHA-256 of several strings: equal for rows that are equal in all of them, nulls included."""
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in cols]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is not in ids (one column). Rows with a null key stay."""
    name = "_gone"
    while name in docs.columns:
        name += "_"
    ids = ids.toDF(name).where(F.col(name).isNotNull()).distinct()
    if ids.count() <= BROADCAST_IDS:
        ids = F.broadcast(ids)
    return docs.join(ids, docs[key].cast(ids.schema[name].dataType) == ids[name], "left_anti")
