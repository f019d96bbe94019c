"""Diagnostic reports over decided claims and labels: added sources, split sentences, directions of inference (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.evaluate import ratio

#: Bands of gain and of relative gain, bounds of distance, saturation, prefilter.
GAINS = (0.00, 0.12, 0.16, 0.20, 0.25, 0.35, 1.01)
RELATIVE = (0.00, 0.20, 0.35, 0.50, 0.70, 1.01)
NEAR, FAR = 2, 8
SATURATED = (0.05, 0.95)
#: Parts of 0..1 in which a median is sought first.
PARTS = 1024
MOST_COVERED, LEAST_ENTAILED, LEAST_FORWARD = 0.80, 0.50, 0.70


def judged(si: Column, needed: Column, allowed: Column) -> Column:
    return F.when(F.array_contains(needed, si), "notwendig").when(F.array_contains(allowed, si), "zulaessig").otherwise("falsch")


def added_sources(claims: DataFrame) -> DataFrame:
    """Every source that the greedy cover added, with gain, step, distance to the sources before, what was left, relative gain, verdict.

    ``claims`` has (pair_id, ci, srcs, redundant, gains, cov_total, needed, allowed); claims whose labels need nothing are no measure.
    """
    rows = claims.filter(F.size("needed") > 0).select("*", F.posexplode("gains").alias("step", "g")).withColumn("si", F.col("g.si"))
    before = F.concat(F.array(F.col("srcs")[0]), "redundant", F.transform(F.slice("gains", F.lit(1), F.col("step")), lambda g: g["si"]))
    rest = F.slice("gains", F.col("step") + 1, F.size("gains"))
    left = 1 - F.col("cov_total") + F.aggregate(rest, F.lit(0.0), lambda s, g: s + g["gain"])
    rows = rows.withColumn("left", F.greatest(F.lit(0.0), left))
    return rows.select(
        "pair_id", "ci", "si", F.col("g.gain").alias("gain"), (F.col("step") + 1).alias("step"),
        F.array_min(F.transform(before, lambda s: F.abs(s - F.col("si")))).alias("distance"), "left",
        F.when(F.col("left") > 0.01, F.col("g.gain") / F.col("left")).alias("relative"), judged(F.col("si"), F.col("needed"), F.col("allowed")).alias("verdict"),
    )


def band(value: Column, edges: tuple[float, ...]) -> Column:
    """The lower edge of the value's band; null outside all."""
    out = F.lit(None).cast("double")
    for low, high in zip(edges, edges[1:], strict=False):
        out = F.when((value >= low) & (value < high), F.lit(low)).otherwise(out)
    return out


def reach(distance: Column) -> Column:
    return F.when(distance <= NEAR, "nah").when(distance < FAR, "mittel").otherwise("fern")


def hit_rates(rows: DataFrame, by: Column) -> DataFrame:
    """Counts of verdicts and the share that is not wrong, per value of ``by``."""
    n = lambda v: F.count(F.when(F.col("verdict") == v, 1)).alias(v)
    out = rows.groupBy(by.alias("band")).agg(F.count("*").alias("n"), n("notwendig"), n("zulaessig"), n("falsch"))
    return out.withColumn("rate", ratio(F.col("n") - F.col("falsch"), F.col("n")))


def all_hit_rates(rows: DataFrame, by: dict[str, Column]) -> DataFrame:
    """``hit_rates`` of several values, with ``kind``: rows are counted by all of them together first, and so read once."""
    verdicts = ("notwendig", "zulaessig", "falsch")
    few = rows.groupBy(*(v.cast("string").alias(f"by_{k}") for k, v in by.items())).agg(F.count("*").alias("n"), *(F.count(F.when(F.col("verdict") == v, 1)).alias(v) for v in verdicts))
    each = few.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"by_{k}").alias("band")) for k in by))).alias("b"), "n", *verdicts)
    out = each.groupBy("b.kind", "b.band").agg(*(F.sum(c).alias(c) for c in ("n", *verdicts)))
    return out.withColumn("rate", ratio(F.col("n") - F.col("falsch"), F.col("n")))


def plain_sources(claims: DataFrame) -> DataFrame:
    """kind, n, falsch: the first, the redundant and the anchors' sources, to compare with added ones."""
    rows = claims.filter(F.size("needed") > 0)
    gained = F.transform("gains", lambda g: g["si"])
    kinds = {"primaer": F.when(F.size("srcs") > 0, F.slice("srcs", 1, 1)), "redundant": F.col("redundant"), "anker": F.array_except("extra", gained)}
    each = rows.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("s")) for k, v in kinds.items()))).alias("k"), "needed", "allowed")
    each = each.select("k.kind", F.explode("k.s").alias("si"), "needed", "allowed")
    return each.groupBy("kind").agg(F.count("*").alias("n"), F.count(F.when(judged(F.col("si"), F.col("needed"), F.col("allowed")) == "falsch", 1)).alias("falsch"))


def split_or_whole(sentences: DataFrame) -> DataFrame:
    """Errors of split and whole sentences (n_claims, sources, needed, allowed): counts, precision, recall and shares of all errors."""
    wrong = F.size(F.array_except("sources", F.array_union("needed", "allowed")))
    rows = sentences.select(
        (F.col("n_claims") > 1).alias("split"), F.size("sources").alias("given"), F.size("needed").alias("needed"), wrong.alias("fp"),
        F.size(F.array_except("needed", "sources")).alias("fn"), ((F.size("needed") > 0) & (F.size("sources") == 0)).cast("long").alias("none"),
    )
    sums = rows.groupBy("split").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("none", "needed", "fn", "fp", "given")))
    every = Window.partitionBy(F.lit(0))  # two rows
    share = lambda c: ratio(F.col(c), F.sum(c).over(every)).alias(f"{c}_share")
    return sums.select("*", ratio(F.col("needed") - F.col("fn"), F.col("needed")).alias("cir"), ratio(F.col("given") - F.col("fp"), F.col("given")).alias("cip"), share("n"), share("none"), share("fn"))


def prefiltered(cases: DataFrame) -> DataFrame:
    """Cases (cov, entail) in which a claim may follow from its sources without standing in them."""
    return cases.filter((F.col("cov") <= MOST_COVERED) & (F.col("entail") >= LEAST_ENTAILED))


def spreads(cases: DataFrame, values: list[str], by: str) -> DataFrame:
    """(by, value, n, least, median, most, saturated) of each column; the median is the element at n // 2."""
    each = cases.select(by, F.explode(F.array(*(F.struct(F.lit(v).alias("value"), F.col(v).alias("x")) for v in values))).alias("v")).select(by, "v.*").filter("x is not null")
    counted = each.groupBy(by, "value", "x").agg(F.count("*").alias("c"))
    # parts of the values in order: first the part that holds the median, then its place there
    x = F.col("x").cast("double")
    part = F.when(F.isnan(x), PARTS).otherwise(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)) * (PARTS - 1)))
    counted = counted.withColumn("part", part.cast("int"))
    extreme = (F.col("x") <= SATURATED[0]) | (F.col("x") >= SATURATED[1])
    parts = counted.groupBy(by, "value", "part").agg(F.sum("c").alias("c"), F.min("x").alias("least"), F.max("x").alias("most"), F.sum(F.when(extreme, F.col("c")).otherwise(0)).alias("saturated"))
    group = Window.partitionBy(by, "value")
    parts = parts.withColumn("upto", F.sum("c").over(group.orderBy("part"))).withColumn("n", F.sum("c").over(group))
    half = F.floor(F.col("n") / 2)
    held = parts.filter((F.col("upto") > half) & (F.col("upto") - F.col("c") <= half)).select(F.col(by).alias("__by"), F.col("value").alias("__value"), F.col("part").alias("__part"), (half - F.col("upto") + F.col("c")).alias("k"))
    same = lambda *names: [F.col(c).eqNullSafe(F.col(f"__{n}")) for c, n in zip((by, "value", "part"), names)]
    inside = counted.join(F.broadcast(held), same("by", "value", "part")).withColumn("upto", F.sum("c").over(group.orderBy("x")))
    median = inside.filter((F.col("upto") > F.col("k")) & (F.col("upto") - F.col("c") <= F.col("k"))).select("__by", "__value", F.col("x").alias("median"))
    out = parts.groupBy(by, "value").agg(F.sum("c").alias("n"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("saturated").alias("saturated"))
    return out.join(F.broadcast(median), same("by", "value")).drop("__by", "__value")


def gap(cases: DataFrame) -> DataFrame:
    """One row: how far the least delta of 'inferiert' lies above the greatest of 'direkt', among cases whose forward direction holds.

    Cases have (relation, V, R_span); n_dropped are those whose forward direction fails.
    """
    delta = F.col("V") - F.col("R_span")
    holds = F.col("V") >= LEAST_FORWARD
    of = lambda r, f: f(F.when(holds & (F.col("relation") == r), delta))
    n = lambda r: F.count(F.when(holds & (F.col("relation") == r), 1))
    out = cases.agg(n("direkt").alias("n_direkt"), n("inferiert").alias("n_inferiert"), F.count(F.when(~holds, 1)).alias("n_dropped"), of("direkt", F.max).alias("most"), of("inferiert", F.min).alias("least"))
    return out.select("n_direkt", "n_inferiert", "n_dropped", (F.col("least") - F.col("most")).alias("gap"))


def reached(cases: DataFrame) -> DataFrame:
    """One row: how many shifted claims have a forward direction that holds."""
    return cases.agg(F.count("*").alias("n"), F.count(F.when(F.col("V") >= LEAST_FORWARD, 1)).alias("reached"))
