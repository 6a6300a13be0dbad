"""What the operators of this package share: table reading, shared storage, text conventions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.sources.tables import spread

#: Word separators of every contract here: space and \t \n \v \f \r.
WHITE = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A whole input table; the path may be of any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """A whole table of texts, for which rows are much work, over all cores even if it is a small file."""
    return spread(table(spark, sf_dir, name))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Only a local session (tests) may leave it unset and gets a fresh folder."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set: intermediate tables need a folder that all executors share")
        where = tempfile.mkdtemp(prefix="spark-checkpoint-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def _intermediates(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/weftline-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to shared storage and read back: cuts the lineage and survives lost executors. See clear."""
    spark = df.sparkSession
    path = f"{_intermediates(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes what this application's operators have written; for when their results are stored, as results read it."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(_intermediates(spark))
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def tasks(spark: SparkSession) -> int:
    """The number of partitions for explicit repartitions, as configured for the session's data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """df.where(condition) on computed columns, without Spark moving the filter below their projection, where each use would
    compute them anew: a filter doesn't pass a projection that numbers the rows."""
    return df.withColumn("_numbered", F.monotonically_increasing_id()).where(condition & (F.col("_numbered") >= 0)).drop("_numbered")


def bounded_sample(df: DataFrame, keys: list[str], n: int) -> DataFrame:
    """At most n rows of df by the hash of keys; of large tables only about 4 n rows come to the choice."""
    total = df.count()
    if total > 4 * n:
        df = df.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 40)) < (4 * n << 40) // total)
    return df.orderBy(F.xxhash64(*keys), *keys).limit(n)
