"""Line dedup across documents: exact repeats, and near repeats by a deletion-neighbourhood join.

Lines are compared without outer blanks; blank ones are always kept. Exact repeats go whatever
their length, near repeats from ``MIN_CHARS`` characters on (of both lines), as one edit makes
another word of a short line. Documents are ordered by id (null last), then by a hash
of the text; lines by document, then place. A line goes if an earlier one is equal, or if an
earlier line of the input is within ``edits`` (``EDITS``: insert, delete or replace a
code point) of it; so the earliest line of every such pair stays in some document, and what is
removed does not depend on partitions or on what else goes.

Near repeats: every distinct line emits its deletion variants (up to ``edits`` places left out)
as hashed keys with these places. A place left out is either replaced, a hole at the same place
of both lines, or deleted. Lines of the same variant with the same r holes, of which one has d
and the other i more places deleted, are r + d + i edits apart at most, and every pair within
``edits`` has such a variant. So each line is joined with the earliest of its group for every
number of deletions that fits, never pair by pair, and the edit distance of the texts is
verified. Only lines that share one of ``edits`` + 1 parts with a different line of fitting length
emit variants: that many edits leave one part of a line as it is, so no pair is lost.
A line of n characters has about n ** edits / edits! variants: costs grow steeply with the bound.

Scale: text is exploded once into narrow rows (hashes) that are written; groups are
pre-aggregated (a line in a third of all documents is one row per task); texts are read again
for the few lines in question and at the end.

Defined results: a null text stays null; rows of equal id and text are one document (they get the
same lines); empty tables give empty results; further columns of the input are kept as
they are, but for columns named like the two counts (``names``), which these replace; a text that loses all
lines becomes empty. Very long texts are split and joined in one row; ties of order are settled by the text's hash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.bytesops import mix, powers, prefix_sums
from tracewell.llm.shared import only, salted_join, written

MIN_CHARS = 16
EDITS = 1
#: A broadcast of line hashes beyond this many rows becomes a shuffled join.
BROADCAST_ROWS = 200_000

TEXT_HASH = "xxhash64(text, 11)"


def exploded(docs: DataFrame, min_chars: int | None) -> DataFrame:
    """Every line of at least min_chars characters (none: that is not blank): its order and trimmed text."""
    line = F.posexplode(F.split("text", "\n", -1)).alias("line", "raw")
    rows = docs.select("doc_id", "text", F.expr(TEXT_HASH).alias("text_hash")).select("doc_id", "text_hash", line)
    wanted = F.length("s") >= (MIN_CHARS if min_chars is None else min_chars)
    wanted = wanted | F.col("s").rlike(r"\S") if min_chars is None else wanted
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash", "line")
    return rows.select(order.alias("at"), F.trim("raw").alias("s")).filter(wanted)


def identity(s: str = "s") -> list[F.Column]:
    """Two independent hashes, which stand for a line."""
    return [F.xxhash64(s).alias("h1"), F.xxhash64(F.lit(7), s).alias("h2")]


def shared_parts(edits: int) -> F.Column:
    """Keys of the parts a line shares with any line up to ``edits`` away (see the module)."""
    n = F.length("s")

    def of(m: F.Column) -> list[F.Column]:
        cuts = [F.floor(m * i / (edits + 1)).cast("int") for i in range(edits + 1)] + [m]
        out = []
        for i in range(edits + 1):
            size = cuts[i + 1] - cuts[i]
            # the first part has its place from the front, the last one from the end
            shifts = [F.lit(0)] if i == 0 else [n - m] if i == edits else [F.lit(k) for k in range(-edits, edits + 1)]
            starts = [cuts[i] + k for k in shifts]
            out += [F.when((m >= 0) & (b >= 0), F.xxhash64(F.lit(i), m, F.col("s").substr(b + 1, size))) for b in starts]
        return out

    return F.array_compact(F.array(*(key for k in range(edits + 1) for key in of(n - k))))


def broadcast_if_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


VARIANTS = "h1 long, h2 long, key long, places array<int>"
_ROWS = 1 << 18


def left_out(n: int, edits: int) -> Iterator[np.ndarray]:
    """Ascending places of 0..edits of n characters, one choice a row, a bounded number of rows at a time."""
    yield np.zeros((1, 0), np.int64)
    if edits:
        yield np.arange(n)[:, None]
    for c in range(2, min(edits, n) + 1):
        every = combinations(range(n), c)
        while some := list(islice(every, _ROWS)):
            yield np.array(some, np.int64)


def variants(lines: DataFrame, edits: int) -> DataFrame:
    """A key of each line without up to ``edits`` characters, with their places in what remains."""

    def table(parts: list) -> pa.RecordBatch:
        h1, h2, key, size, places = (np.concatenate(c) for c in zip(*parts, strict=True))
        offsets = np.append(0, np.cumsum(size)).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(places))
        return pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(key), lists], names=["h1", "h2", "key", "places"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, waiting = [], 0
        for batch in batches:
            ids = [batch.column(c).to_numpy() for c in ("h1", "h2")]
            for i, s in enumerate(batch.column("s").to_pylist()):
                points = np.frombuffer(s.encode("utf-32-le"), np.uint32).astype(np.uint64)
                sums = prefix_sums(points + np.uint64(1))
                n = len(points)
                _, down = powers(n + 1)
                for out in left_out(n, edits):
                    m, c = out.shape
                    value, start = np.zeros(m, np.uint64), np.zeros(m, np.int64)
                    for j in range(c + 1):
                        stop = out[:, j] if j < c else np.full(m, n)
                        # what follows j places left out moves j places to the left
                        value += (sums[stop] - sums[start]) * down[j]
                        start = stop + 1
                    key = mix(value + np.uint64(n - c))
                    places = (out - np.arange(c)).astype(np.int32).ravel()
                    parts.append((*(np.full(m, x[i]) for x in ids), key.view(np.int64), np.full(m, c), places))
                    waiting += m
                    if waiting >= _ROWS:
                        yield table(parts)
                        parts, waiting = [], 0
        if parts:
            yield table(parts)

    return lines.select("h1", "h2", "s").mapInArrow(run, VARIANTS)


def shared_variants(lines: DataFrame, edits: int) -> DataFrame:
    """The variants that different lines share, with the place ``at`` of each line."""
    keys = variants(lines, edits)
    shared = keys.groupBy("key").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo != hi").select("key")
    shared = written(shared, "shared_variants")
    kept = keys.join(broadcast_if_small(shared), "key", "left_semi")
    return written(kept.join(lines.select("h1", "h2", "at"), ["h1", "h2"]), "variants")


def near_pairs(keys: DataFrame, edits: int) -> DataFrame:
    """(h1, h2) of a line and (e1, e2) of an earlier one that may be within ``edits`` of it."""
    choice = F.explode(F.expr("sequence(0, shiftleft(1, size(places)) - 1)")).alias("choice")
    rows = keys.select("h1", "h2", "at", "key", "places", choice)
    rows = rows.withColumn("holes", F.expr("filter(places, (x, i) -> (shiftright(choice, i) & 1) = 1)"))
    rows = rows.select("h1", "h2", "at", "key", "holes", (F.size("places") - F.size("holes")).alias("gone"))
    groups = rows.groupBy("key", "holes", "gone").agg(F.min(F.struct("at", "h1", "h2")).alias("e")).withColumnRenamed("gone", "gone_e")
    near = rows.join(groups, ["key", "holes"]).filter(F.size("holes") + F.col("gone") + F.col("gone_e") <= edits).filter("at > e.at")
    return near.select("h1", "h2", F.col("e.h1").alias("e1"), F.col("e.h2").alias("e2")).distinct()


def removed_lines(docs: DataFrame, min_chars: int | None = None, edits: int = EDITS) -> DataFrame:
    """doc_id, text_hash and the places ``gone`` of the lines to remove."""
    near_chars = MIN_CHARS if min_chars is None else min_chars
    parts = F.when(F.length("s") >= near_chars, shared_parts(edits)).otherwise(F.array().cast("array<bigint>"))
    lines = written(exploded(docs, min_chars).select("at", *identity(), parts.alias("parts")), "lines")
    first = lines.groupBy("h1", "h2").agg(F.min("at").alias("first"), F.count("*").alias("n"), F.min("parts").alias("parts"))
    first = written(first, "first_lines")

    shared = first.select("h1", F.explode(F.array_distinct("parts")).alias("part"))
    shared = shared.groupBy("part").agg(F.min("h1").alias("lo"), F.max("h1").alias("hi")).filter("lo != hi").select("part")
    narrow = first.select("h1", "h2", "first", F.explode(F.array_distinct("parts")).alias("part"))
    suspects = narrow.join(shared, "part", "left_semi").select("h1", "h2", "first").distinct()
    suspects = written(suspects, "suspects")

    found = exploded(docs, near_chars).select("at", "s", *identity())
    texts = found.join(broadcast_if_small(suspects), ["h1", "h2"]).filter(F.col("at") == F.col("first"))
    texts = written(texts.groupBy("h1", "h2").agg(F.first("at").alias("at"), F.first("s").alias("s")), "line_texts")
    pairs = near_pairs(shared_variants(texts, edits), edits)
    mine, other = texts.select("h1", "h2", "s"), texts.select(F.col("h1").alias("e1"), F.col("h2").alias("e2"), F.col("s").alias("e"))
    verified = pairs.join(mine, ["h1", "h2"]).join(other, ["e1", "e2"]).filter(F.levenshtein("s", "e", edits) >= 0)
    near = written(verified.select("h1", "h2").distinct(), "near_lines")

    several = first.filter("n > 1").select("h1", "h2", "first", "n", F.lit(False).alias("near"))
    single = first.join(broadcast_if_small(near), ["h1", "h2"], "left_semi").select("h1", "h2", "first", "n", F.lit(True).alias("near"))
    rules = several.unionByName(single).groupBy("h1", "h2").agg(F.first("first").alias("first"), F.max("n").alias("n"), F.max("near").alias("near"))
    gone = salted_join(lines.select("at", "h1", "h2"), written(rules, "rules"), ["h1", "h2"], "n").filter("near or at > first")
    return gone.groupBy("at.doc_id", "at.text_hash").agg(F.collect_set("at.line").alias("gone"))


def dedup_lines(docs: DataFrame, min_chars: int | None = None, edits: int = EDITS, names: tuple[str, str] = ("n_lines", "n_removed_lines")) -> DataFrame:
    """``docs`` with the shortened text, and two counts of lines, all and removed ones (long).

    A ``min_chars`` is the least length of all lines that may go, of exact repeats too.
    """
    gone = only(docs.sparkSession, lambda: removed_lines(docs, min_chars, edits), "removed_lines")
    gone = gone.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__hash"), F.col("gone").alias("__gone"))
    keyed = docs.withColumn("__text", F.expr(TEXT_HASH))
    same = keyed["doc_id"].eqNullSafe(gone["__doc"]) & (keyed["__text"] == gone["__hash"])
    both = keyed.join(gone, same, "left")
    lines = F.split("text", "\n", -1)
    # a set difference, linear in the lines of a text
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), "__gone")
    n_removed = F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long")
    kept = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(lines, i)), "\n"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    out = [kept.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns if c not in names]
    return both.select(*out, n_lines.alias(names[0]), n_removed.alias(names[1]))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All lines of all documents."""
    out = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", F.col("n_removed_lines").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
