"""Written tables in the shared folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; where none is named and all runs on one machine (tests), a folder of it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="tracewell-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder; what is written there goes when the session's JVM ends."""
    place = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return place


#: Tables written since the innermost ``only`` began.
_made: list[list[str]] = [[]]


def only(spark: SparkSession, make: Callable[[], DataFrame], name: str) -> DataFrame:
    """What ``make`` returns, as a written table; the tables written on the way are deleted."""
    _made.append([])
    try:
        out = make()
        path = table_path(spark, name)
        out.write.parquet(path)
    finally:
        for place in _made.pop():
            _delete(spark, place)
    _made[-1].append(path)
    return spark.read.schema(out.schema).parquet(path)


def _delete(spark: SparkSession, place: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = table_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    _made[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, df: DataFrame) -> None:
    """Delete a table made by ``written`` that nothing will read again."""
    for place in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _delete(spark, place)


#: A key is hot beyond this share of all rows, so there are fewer hot keys than this number.
_HOT, _SALTS = 1024, 64


def salted_join(rows: DataFrame, table: DataFrame, key: list[str], n: str) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has every key once and in ``n`` how many rows have it.

    Rows of a hot key are dealt to ``_SALTS`` tasks. Both sides should be written tables.
    """
    total = table.agg(F.sum(n)).first()[0] or 0
    hot = F.col(n) > max(total // _HOT, 1000)
    marks = F.broadcast(table.filter(hot).select(*key, F.lit(1).alias("__hot")))
    salt = F.when(F.col("__hot") == 1, F.pmod(F.monotonically_increasing_id(), F.lit(_SALTS))).otherwise(F.lit(0).cast("long"))
    left = rows.join(marks, key, "left").withColumn("__salt", salt).drop("__hot")
    salts = F.when(hot, F.sequence(F.lit(0).cast("long"), F.lit(_SALTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return left.join(table.withColumn("__salt", F.explode(salts)), [*key, "__salt"]).drop("__salt")
