"""Personal data by patterns, and information-theoretic sanitisation of what surrounds it.

Patterns give the base spans (email, ip, card, phone; see ``base_spans``). Their values are the
protected entities. A term is any word outside all base spans, numbers and words with digits too,
anywhere in a document with an entity. Over the whole corpus, with documents as the unit,

    IC(e) = log(N / df(e))                         information the entity carries
    PMI(t; e) = log(N * joint(t, e) / (df(t) * df(e)))  information the term gives about it
    disclosure = PMI / IC = 1 + log(joint / df(t)) / IC(e)

so 1 means that the term stands for the entity. Every pair seen is rated, entities of a single
document too: joint / df(t) is taken as (joint + s * df(e) / N) / (df(t) + s), s = ``SMOOTH``
documents of which the share df(e) / N has the entity, so few documents count as weak evidence.
Terms of disclosure >= ``REMOVE`` are removed and those >= ``GENERALISE`` are replaced by the word of
their class (number, code, name or word), by the entity they disclose most and wherever they stand, also in
documents without an entity; both give spans of kind ``term``. Base spans always stay spans; in the
sanitised text their kind stands for them.

Scale: no text is shuffled. A first pass sends (entity, term) counts, added up per batch, of the
documents that hold an entity; a second one document counts of words. Rates are joined by
term, per term and frequency of entity. A last pass finds the decided terms in all texts; their
keys travel in groups of ``GROUP_KEYS``, each searched in turn, so the broadcast is bounded. A very long text is
read in one piece, in time linear in its length and spans.

Defined results: a null text is empty (no spans, hash of the empty string); every row gives one
row, repeated rows too; null ids stay null; empty tables give empty results; extra columns are
ignored. Offsets are code points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.bytesops import slices, text_buffers, word_bounds, word_hashes
from tracewell.llm.shared import only, salted_join, written

SMOOTH = 0.5
GENERALISE = 0.8
REMOVE = 0.95
#: Decided terms of one broadcast, and counted pairs a worker holds before it sends them.
GROUP_KEYS = 1 << 20
_PAIRS = 1 << 17
KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: The look-behind only skips starts inside a run of digits, where a match fails as at its start.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """As a left-to-right search would find them, in linear time: each @ is looked at once."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, normalised value) by kind, then start; failing matches are dropped."""
    out = [("email", a, b, text[a:b].lower()) for a, b in _emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", m.start(), m.end(), ".".join(p or "0" for p in parts)))
    for m in _CARD.finditer(text):
        d = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end(), d))
    for m in _PHONE.finditer(text):
        d = "".join(_DIGIT.findall(m[0]))
        if 8 <= len(d) <= 15:
            out.append(("phone", m.start(), m.end(), d))
    return out


def terms_in(text: str, spans: list[tuple[str, int, int, str]]) -> set[str]:
    """The terms of a text outside all base spans."""
    taken = [(a, b) for _, a, b, _ in spans]
    words = [(m.start(), m.end()) for m in _WORD.finditer(text)]
    lows, highs = np.array([a for a, _ in words], np.int64), np.array([b for _, b in words], np.int64)
    cut = np.zeros(len(words), bool)
    for a, b in taken:
        cut[np.searchsorted(highs, a, "right") : np.searchsorted(lows, b)] = True
    return {lower(text[words[k][0] : words[k][1]]) for k in np.flatnonzero(~cut).tolist()}


def lower(word: str) -> str:
    """Lower case in A-Z only, as ``bytesops`` has it."""
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


BASE = "array<struct<kind:string,start:int,stop:int>>"
TERMS = "array<struct<start:int,stop:int,action:string>>"


def marked(part: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, str, list]]:
    """Row, text and base spans of the rows that may hold an entity."""
    marks = np.flatnonzero((part == 0x40) | ((part >= 0x30) & (part <= 0x39)))
    for r in np.unique(np.searchsorted(offsets, marks, "right") - 1).tolist():
        text = part[offsets[r] : offsets[r + 1]].tobytes().decode("utf-8", "replace")
        yield r, text, base_spans(text)


def observed(docs: DataFrame) -> DataFrame:
    """entity, term_key, joint: documents with both; a null term_key: documents with the entity."""

    def table(counts: dict) -> pa.RecordBatch:
        entity, key = zip(*counts, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(entity), pa.array(key, pa.int64()), pa.array(list(counts.values()), pa.int64())], names=["entity", "term_key", "joint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict = {}
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            for i, j in slices(offsets):
                for _, text, spans in marked(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
                    if not spans:
                        continue
                    raw, at = text_buffers(pa.array(sorted(terms_in(text, spans)), pa.string()))
                    keys = [None, *word_hashes(raw, at[:-1], at[1:]).view(np.int64).tolist()]
                    for e in sorted({f"{k}:{v}" for k, _, _, v in spans}):
                        for key in keys:
                            counts[e, key] = counts.get((e, key), 0) + 1
                        if len(counts) >= _PAIRS:
                            yield table(counts)
                            counts = {}
        if counts:
            yield table(counts)

    rows = docs.select("text").mapInArrow(run, "entity string, term_key long, joint long")
    return rows.groupBy("entity", "term_key").agg(F.sum("joint").alias("joint"))


def word_frequencies(docs: DataFrame) -> DataFrame:
    """term_key (hash of a word), df: number of documents with the word, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffers(batch.column("text"))
            keys = []
            for i, j in slices(offsets):
                part = data[offsets[i] : offsets[j]]
                start, stop, row = word_bounds(part, offsets[i : j + 1] - offsets[i])
                h = word_hashes(part, start, stop)
                order = np.argsort(h, kind="stable")  # rows stay ascending within a word
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                keys.append(h[new])
            keys, n = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], names=["term_key", "df"])

    return docs.select("text").mapInArrow(run, "term_key long, df long").groupBy("term_key").agg(F.sum("df").alias("df"))


def disclosures(docs: DataFrame, smooth: float = SMOOTH, generalise: float = GENERALISE, remove: float = REMOVE) -> DataFrame:
    """term_key, disclosure (of the entity it tells most about), action for the terms beyond the threshold."""
    n = docs.count()
    pairs = written(observed(docs), "joint")
    per_entity = pairs.groupBy("entity").agg(F.max(F.when(F.col("term_key").isNull(), F.col("joint"))).alias("df_entity"), F.count("term_key").alias("n_terms"))
    per_entity = written(per_entity.filter((F.col("df_entity") < n) & (F.col("n_terms") > 0)), "entities")
    joint = salted_join(pairs.filter("term_key is not null"), per_entity, ["entity"], "n_terms")
    # at equal frequency of the entity, more joint documents disclose more
    joint = written(joint.groupBy("term_key", "df_entity").agg(F.max("joint").alias("joint")), "rates")
    df = word_frequencies(docs).join(joint.select("term_key").distinct(), "term_key", "left_semi")
    given = (F.col("joint") + smooth * F.col("df_entity") / max(n, 1)) / (F.col("df") + smooth)
    rate = 1 + F.log(F.least(given, F.lit(1.0))) / F.log(F.lit(float(max(n, 2))) / F.col("df_entity"))
    rated = joint.join(df, "term_key").groupBy("term_key").agg(F.max(rate).alias("disclosure")).filter(F.col("disclosure") >= generalise)
    return rated.withColumn("action", F.when(F.col("disclosure") >= remove, "remove").otherwise("generalise"))


def covering(spans: list[tuple[int, int]], start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Which of the ranges overlap any span."""
    spans = sorted(spans)
    lows, ends = np.array([a for a, _ in spans]), np.maximum.accumulate(np.array([b for _, b in spans]))
    before = np.searchsorted(lows, stop) - 1
    return (before >= 0) & (ends[before] > start)


def _marker(tables, last: bool):
    """mapInArrow function: the rows again, with base spans and this group's terms; the last one sanitises the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, removed = tables.value
        base_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
        term_type = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("action", pa.string())]))
        for batch in batches:
            base: list[list] = [[] for _ in range(batch.num_rows)]
            terms: list[list] = batch.column("terms").to_pylist()
            data, offsets = text_buffers(batch.column("text"))
            for i, j in slices(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                for r, _, spans in marked(part, at):
                    base[i + r] = [{"kind": k, "start": a, "stop": b} for k, a, b, _ in spans]
                if not len(keys) or not len(part):
                    continue
                start, stop, row = word_bounds(part, at)
                h = word_hashes(part, start, stop).view(np.int64)
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = np.flatnonzero(keys[k] == h)
                points = np.append(0, np.cumsum((part & 0xC0) != 0x80))  # code points before each byte
                first = points[at[row[hit]]]
                a, b, gone = points[start[hit]] - first, points[stop[hit]] - first, removed[k[hit]]
                cuts = np.append(np.flatnonzero(np.diff(row[hit], prepend=-1)), len(hit))
                for x, y in zip(cuts, cuts[1:], strict=False):
                    r = i + int(row[hit[x]])
                    free = ~covering([(z["start"], z["stop"]) for z in base[r]], a[x:y], b[x:y]) if base[r] else np.ones(y - x, bool)
                    terms[r] += [{"start": p, "stop": q, "action": "remove" if g else "generalise"} for p, q, g in zip(a[x:y][free].tolist(), b[x:y][free].tolist(), gone[x:y][free].tolist(), strict=True)]
            text = batch.column("text")
            if last:
                old = text.to_pylist()
                new = [t if t is None or not (m or n) else apply_spans(t, [(z["kind"], z["start"], z["stop"]) for z in m], [(z["start"], z["stop"], z["action"]) for z in n]) for t, m, n in zip(old, base, terms, strict=True)]
                text = pa.array(new, pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), text, pa.array(base, base_type), pa.array(terms, term_type)], names=["doc_id", "text", "base", "terms"])

    return run


def sanitise(docs: DataFrame, group_keys: int = GROUP_KEYS, **thresholds) -> DataFrame:
    """doc_id, the sanitised text, base spans and the term spans with their action, one row per document.

    Spans are those of the text as it was; a null text stays null.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    decided = only(spark, lambda: disclosures(docs, **thresholds), "disclosures")
    groups = max(1, -(-decided.count() // group_keys))
    out = docs.select("doc_id", "text", F.expr(f"cast(array() as {BASE}) base"), F.expr(f"cast(array() as {TERMS}) terms"))
    for g in range(groups):
        part = decided.filter(F.pmod("term_key", F.lit(groups)) == g).select("term_key", F.expr("action = 'remove'").alias("removed")).toArrow()
        keys, removed = part.column("term_key").to_numpy(), part.column("removed").to_numpy()
        order = np.argsort(keys)
        tables = spark.sparkContext.broadcast((keys[order], removed[order].astype(bool)))
        out = out.mapInArrow(_marker(tables, g == groups - 1), f"doc_id long, text string, base {BASE}, terms {TERMS}")
    return out.select("doc_id", "text", "base", F.array_sort("terms").alias("terms"))


def sanitise_spans(docs: DataFrame, group_keys: int = GROUP_KEYS, **thresholds) -> DataFrame:
    """doc_id, base spans and the term spans with their action."""
    return sanitise(docs, group_keys, **thresholds).drop("text")


def class_word(term: str) -> str:
    """What a term is generalised to."""
    if term.isdigit():
        return "<number>"
    return "<code>" if any(c.isdigit() for c in term) else "<name>" if term[:1].isupper() else "<word>"


def apply_spans(text: str, base: list[tuple[str, int, int]], terms: list[tuple[int, int, str]]) -> str:
    """The sanitised text: base spans become their kind, terms the word of their class or nothing; of spans that overlap the first counts."""
    edits = [(a, b, f"<{k}>") for k, a, b in base] + [(a, b, class_word(text[a:b]) if act == "generalise" else "") for a, b, act in terms]
    out, at = [], 0
    for a, b, new in sorted(edits):
        if a >= at:
            out += [text[at:a], new]
            at = b
        elif b > at:  # what sticks out of an overlapping span must not stay either
            at = b
    return "".join(out) + text[at:]


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of personal data and of disclosing terms in all documents."""
    found = sanitise(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    shown = lambda kind, x: F.concat_ws(":", kind, x["start"].cast("string"), x["stop"].cast("string"))
    base = F.transform("base", lambda x: shown(x["kind"], x))
    spans = F.transform(F.array_distinct(F.transform("terms", lambda x: F.struct(x["start"], x["stop"]))), lambda x: shown(F.lit("term"), x))
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    acts = lambda a: F.size(F.filter("terms", lambda x: x["action"] == a)).cast("long")
    return found.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(F.concat_ws(",", base), 256).alias("base_sha256"),
        F.concat_ws(",", F.concat(base, spans)).alias("spans"),
        acts("remove").alias("n_removed"),
        acts("generalise").alias("n_generalised"),
        F.sha2(F.col("text"), 256).alias("sanitised_sha256"),
    )
