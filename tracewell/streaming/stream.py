"""Alignment of a stream of turns: a pair is decided again from all its turns whenever more of them come.

State is kept as tables, so a restart goes on where it was: a batch that is run again overwrites its own epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tracewell.plans.align import align


def align_stream(rows: DataFrame, target: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Keeps the rows (pair_id, side, ord, text) and the decided claims of each batch's pairs under ``target``."""
    schema = T.StructType([*rows.schema.fields, T.StructField("epoch", T.LongType())])

    def batch(df: DataFrame, epoch: int) -> None:
        spark = df.sparkSession
        df.write.mode("overwrite").parquet(f"{target}/turns/epoch={epoch}")
        every = spark.read.schema(schema).parquet(f"{target}/turns").filter(F.col("epoch") <= epoch)
        touched = every.filter(F.col("epoch") == epoch).select("pair_id").distinct()
        known = every.drop("epoch").join(touched, "pair_id", "left_semi").distinct()
        align(known).write.mode("overwrite").parquet(f"{target}/claims/epoch={epoch}")

    writer = rows.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def aligned(spark: SparkSession, target: str) -> DataFrame:
    """The claims of every pair as of its last batch."""
    claims = spark.read.parquet(f"{target}/claims")
    last = F.max("epoch").over(Window.partitionBy("pair_id"))
    return claims.withColumn("__last", last).filter("epoch = __last").drop("__last", "epoch")
