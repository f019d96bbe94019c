"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations.

The ring has 2**16 cells; every shard owns ``vnodes`` places on it. A document's key is its
text, so equal texts meet at one cell. Keys walk clockwise to the next virtual node; a shard
that has reached its bound passes them on to the next node. The bound is exact: with n rows
and m shards, n mod m shards (the first on the ring) hold ceil(n/m) rows and the others
floor(n/m), which is the law ``rows``: counts differ by at most one.

The walk needs only the number of rows per cell, at most 65,536 numbers, so it runs on the
driver for any input; rows find their shard by their rank in the cell. Ranks are taken within
(cell, salt) and shifted by prefix counts; a cell has a salt for each ``rows_per_salt`` of its rows, so a
text that makes up a third of all rows is ranked by many tasks. Rows of a cell are ordered by a hash of id
and text, then by both, so that a task that runs again gives the same slots; very long texts are only hashed.

Defined results: a null text is empty (size 16, crc 0); null ids are ordinary keys; repeated
rows are placed one by one, in any order among themselves; empty input gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import deque

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.shared import written

CELLS = 1 << 16


def ring(shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(cell, shard) of all virtual nodes, clockwise."""
    at = lambda s, v: int.from_bytes(hashlib.md5(f"{s}/{v}".encode()).digest()[:2], "big")
    return sorted((at(s, v), s) for s in range(shards) for v in range(vnodes))


def walk(counts: dict[int, int], shards: int, vnodes: int) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot): ranges of each cell's ranks."""
    nodes = ring(shards, vnodes)
    total = sum(counts.values())
    room = [total // shards] * shards
    for s in list(dict.fromkeys(s for _, s in nodes))[: total % shards]:
        room[s] += 1
    filled = [0] * shards
    cells = sorted(counts)
    waiting: deque[list[int]] = deque()
    out, k = [], 0
    for _lap in range(2):
        for cell, shard in nodes:
            while k < len(cells) and cells[k] <= cell:
                waiting.append([cells[k], 0, counts[cells[k]]])
                k += 1
            while waiting and filled[shard] < room[shard]:
                c, lo, hi = waiting[0]
                n = min(hi - lo, room[shard] - filled[shard])
                out.append((c, lo, lo + n, shard, filled[shard]))
                filled[shard] += n
                waiting[0][1] += n
                if lo + n == hi:
                    waiting.popleft()
        for c in cells[k:]:  # beyond the last node: these wait for the first one
            waiting.append([c, 0, counts[c]])
        k = len(cells)
    return out


def shard(docs: DataFrame, shards: int = 40, vnodes: int = 64, rows_per_salt: int = 20_000) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row of ``docs``."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    keyed = written(
        docs.select(
            "doc_id",
            (F.octet_length(text).cast("long") + 16).alias("size"),
            F.crc32(text).cast("long").alias("text_crc32"),
            F.pmod(F.xxhash64(text), F.lit(CELLS)).cast("int").alias("cell"),
            F.xxhash64(F.col("doc_id").cast("string"), F.lit("order"), text).alias("tie"),
        ),
        "ring",
    )
    counts = {r["cell"]: r["n"] for r in keyed.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    salts = spark.createDataFrame([(c, -(-n // rows_per_salt)) for c, n in counts.items()], "cell int, salts int")  # at most 65,536 rows
    keyed = keyed.join(F.broadcast(salts), "cell").withColumn("salt", F.pmod("tie", F.col("salts")).cast("int")).drop("salts")
    groups = keyed.groupBy("cell", "salt").agg(F.count("*").alias("n"))
    ranges = spark.createDataFrame(walk(counts, shards, vnodes), "cell int, lo long, hi long, shard int, slot0 long")
    before = groups.select("cell", "salt", (F.sum("n").over(Window.partitionBy("cell").orderBy("salt")) - F.col("n")).alias("before"))
    # a piece: ranks of one (cell, salt) that go to one shard
    pieces = (
        before.join(groups, ["cell", "salt"])
        .join(F.broadcast(ranges), "cell")  # at most 65,536 cells and two cuts per virtual node
        .filter((F.col("lo") < F.col("before") + F.col("n")) & (F.col("hi") > F.col("before")))
        .select("cell", "salt", "before", "lo", "hi", "shard", "slot0")
    )
    cuts = pieces.groupBy("cell", "salt").agg(F.first("before").alias("before"), F.array_sort(F.collect_list(F.struct("lo", "hi", "shard", "slot0"))).alias("cuts"))
    rank = F.row_number().over(Window.partitionBy("cell", "salt").orderBy("tie", "doc_id", "text_crc32", "size")) - 1
    placed = keyed.withColumn("rank", rank).join(cuts, ["cell", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    placed = placed.withColumn("cut", F.expr("filter(cuts, c -> c.lo <= rank and rank < c.hi)[0]"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.col("cut.shard").alias("shard"),
        (F.col("cut.slot0") + F.col("rank") - F.col("cut.lo")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents into forty shards."""
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
