"""Tables written to the folder that all executors share."""

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset (as in tests) a folder in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_cairn"
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet and read again: the lineage ends there, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Removes tables of written() that nothing reads any more."""
    for t in tables:
        for f in {x.rsplit("/", 1)[0] for x in t.inputFiles()}:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def swept(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of finished steps now: its cleaner waits for the driver's garbage collections."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed(df: DataFrame, name: str, column: str, buckets: int) -> DataFrame:
    """df as a table in the shared folder, one bucket of files for each hash of `column`: grouping by it needs no more shuffle."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.repartition(buckets, column).write.bucketBy(buckets, column).option("compression", "zstd").option("path", f"{shared_dir(spark)}/{table}").saveAsTable(table)
    swept(spark)
    return spark.table(table)


def unbucketed(table: DataFrame) -> None:
    """Removes a table of bucketed() from the catalog and from the folder."""
    name = next(p for p in table.inputFiles()[:1])
    spark, path = table.sparkSession, name.rsplit("/", 1)[0]
    spark.sql(f"DROP TABLE IF EXISTS {path.rsplit('/', 1)[1]}")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
