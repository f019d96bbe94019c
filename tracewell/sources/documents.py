"""JSON run and label documents: scans, split filter, runs by folder, sinks, resume, drafts, metrics log, requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.operators import evaluate

ENTITY = "struct<type:string,surface:string,norm:string,status:string,quelle_surface:string,quelle_norm:string>"
CLAIM = (
    "struct<id:string,start:int,`end`:int,text:string,relation:string,"
    "sources:array<struct<sentence:string,start:int,`end`:int,spans:array<array<int>>,role:string>>,"
    f"confidence:double,margin:double,entities:array<{ENTITY}>,flags:array<string>,"
    "wortlaut:struct<quelle:string,aenderungen:array<struct<claim:string,quelle:string,nah:boolean,aehnlichkeit:double>>>,"
    "note:string,scores:struct<top:double,lex:double,emb:double,anchor:double,nli:double>>"
)
RUN = (
    "pair_id string, meta struct<titel:string,quelle:string,modell:string,stufen:map<string,boolean>>,"
    "article struct<text:string,sentences:array<struct<id:string,start:int,`end`:int,block:string,level:int,paragraph:int,text:string>>>,"
    f"transcript struct<text:string,claims:array<{CLAIM}>>"
)
ENTRY = (
    "struct<satz:string,text:string,start:int,`end`:int,geprueft:boolean,notwendig:array<string>,"
    "zulaessig:array<string>,relation:string,flags_erwartet:array<string>>"
)
GOLD = f"paar string, split string, artikel_hash string, transkript_hash string, artikel_saetze array<struct<id:string,text:string>>, eintraege array<{ENTRY}>"
#: Fixed value: characters of a text that a request may have.
MOST_CHARS = 200_000


def _scan(spark: SparkSession, path: str | list[str], lines: bool) -> DataFrame:
    docs = spark.read.schema(RUN + ", _corrupt_record string").option("columnNameOfCorruptRecord", "_corrupt_record").json(path, multiLine=not lines)
    name = F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.json)?$", 1)
    return docs.withColumns({"file": F.input_file_name(), "run": F.regexp_extract(F.input_file_name(), "([^/]+)/[^/]+$", 1), "pair_id": F.coalesce("pair_id", name)})


def runs(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Run documents of a folder, a pattern or a file, one a file or one a line, with pair_id and the name of their folder.

    Broken files and those without both texts are left out; ``unreadable`` names them.
    """
    return _scan(spark, path, lines).filter("article.text is not null and transcript.text is not null").drop("_corrupt_record")


def unreadable(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """(file, reason) of the documents that ``runs`` leaves out."""
    docs = _scan(spark, path, lines).filter("article.text is null or transcript.text is null")
    return docs.select("file", F.when(F.col("_corrupt_record").isNotNull(), "broken").otherwise("no texts").alias("reason"))


def run_folders(spark: SparkSession, path: str, first: tuple[str, ...] = ("voll", "basis")) -> DataFrame:
    """(run, place, n): the folders below ``path`` that hold documents; the named ones come first, the others by name."""
    rows = runs(spark, f"{path}/*/*.json").groupBy("run").agg(F.count("*").alias("n"))
    known = F.array_position(F.array(*map(F.lit, first)), F.col("run"))
    order = F.struct(F.when(known > 0, known).otherwise(len(first) + 1).alias("k"), "run")
    every = rows.agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), "n"))).alias("x"))  # one row per folder
    return every.select(F.posexplode("x").alias("place", "x")).select(F.col("x.o.run").alias("run"), "place", F.col("x.n").alias("n"))


def gold(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(GOLD).json(path, multiLine=True)


def labels(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Reviewed label entries, of one split if named."""
    docs = gold(spark, path)
    docs = docs if split is None else docs.filter(F.coalesce("split", F.lit("dev")) == split)
    return docs.select("paar", "split", "transkript_hash", F.explode("eintraege").alias("e")).select("paar", "split", "transkript_hash", "e.*").filter("geprueft")


def other_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """transkript_hash of the labelled pairs that are not in the split: their runs are no errors."""
    return gold(spark, path).filter(F.coalesce("split", F.lit("dev")) != split).select("transkript_hash").distinct()


def written(spark: SparkSession, target: str) -> DataFrame | None:
    """pair_id of the documents under ``target``; None if there is nothing yet."""
    try:
        return spark.read.schema("pair_id string").json(target).select("pair_id").distinct()
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return None


def unfinished(pairs: DataFrame, spark: SparkSession, target: str) -> DataFrame:
    """Pairs without a document in the target (resume)."""
    done = written(spark, target)
    return pairs if done is None else pairs.join(done, "pair_id", "left_anti")


def write_runs(docs: DataFrame, target: str) -> None:
    """Appends run documents, one a line; Spark's commit makes a part appear whole or not at all."""
    docs.write.mode("append").json(target)


def align_all(pairs: DataFrame, target: str, trace) -> None:
    """Traces the pairs that the target lacks and writes their documents; may be called again after a failure."""
    spark = pairs.sparkSession
    write_runs(trace(unfinished(pairs, spark, target)), target)


def write_drafts(drafts: DataFrame, target: str, update: bool = False) -> None:
    """Writes label drafts (pair_id, satz, hash, reviewed, ...) as a table of their own.

    An existing target is refused, or with ``update`` merged: reviewed entries stay, and so do all of a text that has changed.
    """
    spark = drafts.sparkSession
    try:
        old = spark.read.schema(drafts.schema).json(target)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        drafts.write.json(target)
        return
    if not update:
        raise FileExistsError(target)
    values = [c for c in drafts.columns if c not in ("pair_id", "satz", "hash", "reviewed")]
    both = evaluate.merged(drafts, old, ["pair_id", "satz"], values).select(*drafts.columns)
    gone = old.join(drafts.select("pair_id").distinct(), "pair_id", "left_anti")  # pairs that have no new draft
    # a checkpoint first: the table that is read is replaced
    both.unionByName(gone.select(*drafts.columns)).checkpoint().write.mode("overwrite").json(target)


def log_metrics(metrics: DataFrame, target: str) -> None:
    metrics.withColumn("zeit", F.current_timestamp()).write.mode("append").json(target)


def requested(rows: DataFrame, most: int = MOST_CHARS) -> DataFrame:
    """Requests (article, transcript, ...) with ``status`` 200 or 400 and the error; texts are trimmed."""
    rows = rows.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("article", "transcript")})
    empty = (F.col("article") == "") | (F.col("transcript") == "")
    long = (F.length("article") > most) | (F.length("transcript") > most)
    error = F.when(empty, "article und transcript werden benötigt").when(long, f"Eingabe zu groß (max. {most // 1000}k Zeichen)")
    return rows.withColumn("error", error).withColumn("status", F.when(F.col("error").isNull(), 200).otherwise(400))
