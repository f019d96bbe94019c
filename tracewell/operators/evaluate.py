"""Evaluation against labels: micro and macro precision and recall, 2x2, confusion, flags, sweeps (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY = ("direkt", "aggregiert", "inferiert", "bedeutung_verschoben", "keine_quelle")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b > 0, a / b).otherwise(0.0)


def per_sentence(claims: DataFrame) -> DataFrame:
    """Claims (pair_id, satz, sources, flags, relation) of a sentence as one row; the gravest relation wins."""
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("relation"))
    return claims.groupBy("pair_id", "satz").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("sources")))).alias("sources"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("flags")))).alias("flags"),
        F.max_by("relation", rank).alias("relation"),
    )


def source_scores(rows: DataFrame) -> DataFrame:
    """One row of cip, cir, f1 (micro) and macro_cip, macro_cir from rows (sources, needed, allowed)."""
    n = lambda c: F.size(c)
    right = n(F.array_intersect("sources", F.array_union("needed", "allowed")))
    found = n(F.array_intersect("sources", "needed"))
    given, gold = n("sources"), n("needed")
    sums = rows.select(right.alias("right"), given.alias("given"), found.alias("found"), gold.alias("gold")).agg(
        F.sum("right").alias("right"),
        F.sum("given").alias("given"),
        F.sum("found").alias("found"),
        F.sum("gold").alias("gold"),
        F.avg(F.when(F.col("given") > 0, F.col("right") / F.col("given")).when(F.col("gold") > 0, 0.0)).alias("macro_cip"),
        F.avg(F.when(F.col("gold") > 0, F.col("found") / F.col("gold"))).alias("macro_cir"),
    )
    sums = sums.withColumn("cip", ratio(F.col("right"), F.col("given"))).withColumn("cir", ratio(F.col("found"), F.col("gold")))
    return sums.withColumn("f1", ratio(2 * F.col("cip") * F.col("cir"), F.col("cip") + F.col("cir")))


def two_by_two(rows: DataFrame, gold: str, run: str) -> DataFrame:
    """Counts of two boolean columns with precision and recall of ``run``."""
    hit = lambda g, r: F.count(F.when((F.col(gold) == g) & (F.col(run) == r), 1))
    out = rows.agg(hit(True, True).alias("tp"), hit(False, True).alias("fp"), hit(True, False).alias("fn"), hit(False, False).alias("tn"))
    return out.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn")))


def confusion(rows: DataFrame, gold: str, run: str) -> DataFrame:
    return rows.groupBy(F.col(gold).alias("gold"), F.col(run).alias("run")).agg(F.count("*").alias("n"))


def sweep(rows: DataFrame, score: str, gold: str, thresholds: list[float]) -> DataFrame:
    """Per threshold: kept, wrong, dropped and right; the thresholds are an exploded literal."""
    spread = rows.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds))))
    keep = F.col(score) >= F.col("threshold")
    n = lambda cond: F.count(F.when(cond, 1))
    return spread.groupBy("threshold").agg(n(keep & F.col(gold)).alias("kept"), n(keep & ~F.col(gold)).alias("wrong"), n(~keep & F.col(gold)).alias("dropped"), n(~keep & ~F.col(gold)).alias("right"))


def hash_split(df: DataFrame, text: str, test_share: float) -> DataFrame:
    """hash (first 16 hex digits of SHA-256) and a stable dev/test split by it."""
    digest = F.sha2(F.col(text), 256)
    share = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1000 / 1000
    return df.withColumn("hash", F.substring(digest, 1, 16)).withColumn("split", F.when(share < test_share, "test").otherwise("dev"))


def flag_counts(rows: DataFrame, flags: list[str]) -> DataFrame:
    """flag, tp, fp and fn from rows (gold_flags, run_flags); a flag that never occurs has zeros."""
    spread = rows.select("gold_flags", "run_flags", F.explode(F.array(*map(F.lit, flags))).alias("flag"))
    holds = lambda c: F.coalesce(F.array_contains(c, F.col("flag")), F.lit(False))
    n = lambda cond: F.count(F.when(cond, 1))
    gold, run = holds("gold_flags"), holds("run_flags")
    counted = spread.groupBy("flag").agg(n(gold & run).alias("tp"), n(~gold & run).alias("fp"), n(gold & ~run).alias("fn"))
    every = rows.sparkSession.createDataFrame([(f,) for f in flags], "flag string")
    return every.join(counted, "flag", "left").select("flag", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("tp", "fp", "fn")))


def error_listing(rows: DataFrame, classes: dict[str, Column], order: list[str], most: int) -> DataFrame:
    """The first ``most`` rows of each error class with the class's total n; a row may be in several."""
    named = [F.when(cond, F.lit(name)) for name, cond in classes.items()]
    wrong = rows.withColumn("error", F.explode(F.filter(F.array(*named), lambda x: x.isNotNull())))
    # a limit within a window: every task keeps at most that many rows of a class before the exchange
    first = wrong.withColumn("k", F.row_number().over(Window.partitionBy("error").orderBy(*order))).filter(F.col("k") <= most)
    return first.join(F.broadcast(wrong.groupBy("error").agg(F.count("*").alias("n"))), "error")


def compared(runs: DataFrame, baseline: str, values: list[str]) -> DataFrame:
    """Each run's values with d_<value>, the difference from the run named ``baseline``."""
    base = runs.filter(F.col("run") == baseline).select(*(F.col(v).alias(f"__{v}") for v in values)).limit(1)
    both = runs.join(F.broadcast(base), how="left")
    return both.select("run", *values, *((F.col(v) - F.col(f"__{v}")).alias(f"d_{v}") for v in values))


def placed(claims: DataFrame, entries: DataFrame) -> DataFrame:
    """Adds ``satz``: the label entry (pair_id, satz, start) that a claim (pair_id, ..., start) begins in, or the last before it.

    Entries of a pair are in order and do not overlap, so one window over both replaces the range join.
    """
    names = [c for c in claims.columns if c not in ("pair_id", "start")]
    rows = claims.select("pair_id", "start", F.lit(1).alias("__k"), F.struct(*names).alias("__row"), F.lit(None).cast(entries.schema["satz"].dataType).alias("satz"))
    marks = entries.select("pair_id", "start", F.lit(0).alias("__k"), F.lit(None).cast(rows.schema["__row"].dataType).alias("__row"), "satz")
    before = Window.partitionBy("pair_id").orderBy("start", "__k").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(marks).withColumn("satz", F.last("satz", ignorenulls=True).over(before)).filter("__k = 1")
    return both.select("pair_id", "start", "__row.*", "satz")


def matched_runs(runs: DataFrame, labels: DataFrame, split: str) -> DataFrame:
    """Runs (hash, ...) with the label's ``gold`` id and status: matched, other_split (labelled, but held back) or unmatched."""
    one = labels.groupBy("hash").agg(F.min(F.struct((F.col("split") != split).alias("other"), "gold")).alias("__x"))
    both = runs.join(one, "hash", "left")
    status = F.when(F.col("__x").isNull(), "unmatched").when(F.col("__x.other"), "other_split").otherwise("matched")
    return both.withColumn("gold", F.when(status == "matched", F.col("__x.gold"))).withColumn("status", status).drop("__x")


def derived_relation(needed: Column, reviewed: Column, relation: Column) -> Column:
    """The relation that an entry's needed sources imply, until it is reviewed."""
    n = F.size(needed)
    return F.when(reviewed, relation).when(n == 0, "keine_quelle").when(n == 1, "direkt").otherwise("aggregiert")


def drafted(claims: DataFrame, entries: DataFrame) -> DataFrame:
    """Label drafts: one entry per transcript sentence (pair_id, satz, ...) from the claims (pair_id, satz, ci, relation, sources, flags) in it.

    ``sources`` has (si, role). Needed are the sources that are primary anywhere, admissible the redundant rest; the
    gravest relation and all flags but the uncertain one are expected; ``mixed`` tells of several relations.
    """
    rank = F.array_position(F.array(*map(F.lit, SEVERITY)), F.col("relation"))
    of = lambda redundant: F.transform(F.filter("sources", lambda s: (s["role"] == "redundant") == F.lit(redundant)), lambda s: s["si"])
    rows = claims.select("pair_id", "satz", "ci", "relation", rank.alias("rank"), of(False).alias("needed"), of(True).alias("allowed"), "flags")
    every = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    out = rows.groupBy("pair_id", "satz").agg(
        every("needed").alias("needed"), every("allowed").alias("allowed"), F.max_by("relation", "rank").alias("relation"), every("flags").alias("flags"),
        F.array_sort(F.collect_list("ci")).alias("claims"), (F.countDistinct("relation") > 1).alias("mixed"),
    )
    out = out.withColumns({"allowed": F.array_except("allowed", "needed"), "flags": F.array_remove("flags", "signale_uneinig")})
    both = entries.join(out, ["pair_id", "satz"], "left")
    empty = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("needed", "allowed", "flags", "claims")}
    return both.withColumns({**empty, "relation": F.coalesce("relation", F.lit("keine_quelle")), "mixed": F.coalesce("mixed", F.lit(False)), "reviewed": F.lit(False)})


def merged(drafts: DataFrame, labels: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Drafts (key, hash, reviewed, values) with the reviewed old labels kept, and ``changed``.

    Where a text's hash has changed the old labels' places do not fit any more: all of them are kept as they are and
    ``changed`` is true.
    """
    old = labels.select(*key, *(F.col(c).alias(f"__{c}") for c in ("hash", "reviewed", *values)))
    both = drafts.join(old, key, "left")
    changed = F.coalesce(F.col("__hash") != F.col("hash"), F.lit(False))
    keep = F.coalesce(F.col("__reviewed"), F.lit(False)) | changed
    kept = {c: F.when(keep, F.col(f"__{c}")).otherwise(F.col(c)) for c in values}
    out = both.withColumns({"__keep": keep, "__changed": changed}).withColumns(kept)
    return out.select(*key, F.when(F.col("__changed"), F.col("__hash")).otherwise(F.col("hash")).alias("hash"), F.coalesce("__reviewed", "reviewed").alias("reviewed"), *values, F.col("__changed").alias("changed"))
