"""The folder that driver and executors share, and tables cut off from their lineage there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


#: One machine's own folder: for local sessions alone, as in tests.
LOCAL = "file:///tmp/lodestone-checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A cluster has to name it: its executors do not share the driver's disk. What queries write
    there stays until the cluster's owner empties it, since a lazy result may still read it."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL


def cut(df: DataFrame) -> DataFrame:
    """The rows as written to the shared folder, without the plan that made them nor its estimates of size."""
    spark, context = df.sparkSession, df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_dir(spark))
    made = df.checkpoint()
    # joined to itself each round, an estimate's digits would double
    return DataFrame(spark._jsparkSession.createDataFrame(made._jdf.toJavaRDD(), made._jdf.schema()), spark)
