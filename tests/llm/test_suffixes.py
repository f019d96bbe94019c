"""Repeated passages against a dictionary of all windows."""

import hashlib
import random

from tracewell.llm import suffixes


def brute(docs, n):
    first = {}
    for i, t in docs:
        b, k = (t or "").encode(), (i is None, i or 0)
        for p in range(len(b) - n + 1):
            w = b[p : p + n]
            first[w] = min(first.get(w, k), k)
    out = []
    for i, t in docs:
        b, k = (t or "").encode(), (i is None, i or 0)
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] < k:
                gone[p : p + n] = b"\1" * n
        spans = [p for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1])]
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((i, len(b), sum(gone), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def check(spark, docs, n, **sizes):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(a, b, b"x") for a, b in docs], "doc_id long, text string, kept binary")
    f = suffixes.repeated_spans(d, n, **sizes)
    removed = F.expr("aggregate(spans, 0L, (n, x) -> n + x.stop - x.start)")
    got = f.select("doc_id", "n_bytes", removed.alias("r"), F.size("spans").alias("s"), F.sha2("kept", 256).alias("h")).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(docs, n)


def test_random_overlaps(spark):
    rnd = random.Random(1)
    base = "".join(rnd.choice("abcdé ") for _ in range(600))
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            a = rnd.randint(0, 560)
            parts.append(base[a : a + rnd.randint(5, 90)] if rnd.random() < 0.6 else "".join(rnd.choice("abcdé ") for _ in range(rnd.randint(1, 60))))
        docs.append((rnd.randint(0, 40), "".join(parts)))
    docs += [(None, base), (None, base[:300]), (99, None), (98, ""), (97, "a" * 400), (96, "a" * 51), (95, "ab" * 100), (3, base), (3, base)]
    check(spark, docs, 20)
    check(spark, docs, 50, block_bytes=4000, bucket_bytes=3000)
    check(spark, docs[:0], 50)


def test_long_text_is_cut_into_chunks(spark, monkeypatch):
    rnd = random.Random(2)
    base = "".join(rnd.choice("abc") for _ in range(3000))
    monkeypatch.setattr(suffixes, "CHUNK", 512)
    docs = [(2, base), (1, base[700:1900]), (5, "zz" + base[:1500] + "y" + base[1400:])]
    import pyarrow as pa

    # the passes by hand, in this process, where CHUNK is small
    p = suffixes.Passes(50, 3)
    tables = [pa.table({"block": [k], "doc_id": [i], "text": [t]}) for k, (i, t) in enumerate(docs)]

    def passes(emit, reply, answers):
        sent = [m for k, t in enumerate(tables) for m in emit(k, t, [a for a in answers if a[1] == k])]
        out = [m for m in sent if m[2] == -1]
        for b in range(3):
            out += reply([m for m in sent if m[0] == b and m[2] != -1])
        return out

    a = passes(p.ask_anchors, p.answer_anchors, [])
    a = passes(p.ask_units, p.answer_units, a)
    a = passes(p.ask_windows, p.answer_windows, a)
    got = []
    for k, t in enumerate(tables):
        r = p.spans(t, [m for m in a if m[1] == k]).to_pylist()[0]
        got.append((r["doc_id"], r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()))
    assert sorted(got, key=str) == brute(docs, 50)


def test_buckets_get_equal_shares():
    """Anchors are k-grams of least hash; cut by that hash, the first of 16 buckets got three quarters of them."""
    import pyarrow as pa

    rnd = random.Random(4)
    rows = pa.table({"block": [0] * 40, "doc_id": list(range(40)), "text": ["".join(rnd.choices("abcdefgh ", k=5000)) for _ in range(40)]})
    p = suffixes.Passes(50, 16)
    sent = p.ask_anchors(0, rows, [])
    sizes = [len(m[3]) for m in sent]
    assert len(sizes) == 16 and max(sizes) < 1.3 * min(sizes)
    asked = p.ask_units(0, rows, [(b, 0, 1, a, None, None) for b, _, _, a, _, _ in sent])
    sizes = [len(m[4]) for m in asked]
    assert len(sizes) == 16 and max(sizes) < 1.3 * min(sizes)


def test_query_on_table(spark):
    sf = "/root/testdata/sf0.001"
    got = sorted((tuple(r) for r in suffixes.op5_suffix_dedup(spark, sf).collect()), key=str)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert got == brute(docs, 50)
    assert sum(r[2] for r in got) > 1000
