"""The pipeline, stage by stage, on a small table with planted cases."""

import corpus_pipeline
from tests.llm.test_chosenpath import brute as brute_components
from tests.llm.test_lines import brute as brute_lines
from tracewell.llm import lines

SENT = "the quick brown fox {0} jumps over the lazy dog near the old river bank {0} and then it runs home to sleep"


def documents():
    clean = [(i, "\n".join(SENT.format(f"w{i}x{k} a{k}b{i}") for k in range(4)), "en", "s", 1) for i in range(12)]
    near = [(100, clean[0][1].replace("\n", " ") + " more", "en", "s", 1), (101, clean[0][1].replace("\n", "  ") + " more more", None, "s", 1)]
    bad = [(200, "first " + " ".join(f"bench{i}" for i in range(12)) + " last", "en", "s", 1)]
    odd = [(300, None, "en", "s", 0), (301, "", "en", "s", 0), (302, "123 456 !!!", "en", "s", 0), (303, clean[3][1], "en", "s", 1)]
    return [*clean, *near, *bad, *odd]


def test_stages(spark, tmp_path):
    d = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long")
    sf = str(tmp_path)
    d.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"bench{i}" for i in range(11)))], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.collect()]
        hashes = {r.text: r.h for r in docs.selectExpr("text", f"{lines.TEXT_HASH} h").collect()} if "text" in docs.columns else {}
        out = stage(spark, docs, sf)
        if name != "pieces":
            assert out.columns == d.columns
        out.write.parquet(f"{sf}/{name}")
        docs = spark.read.parquet(f"{sf}/{name}")
        kept[name] = {r.doc_id for r in docs.collect()}
        if name == "language_id":
            assert kept[name] == {i for i, t in before if t and any(c.isalpha() for c in t)}
        if name == "line_dedup":
            want = {i: t for i, t in brute_lines(before, hashes, lines.MIN_CHARS) if t.strip()}
            assert {r.doc_id: r.text for r in docs.collect()} == want and 303 not in want
        if name == "ngram_join":
            assert kept[name] == {i for i, _, c in brute_components(before) if i == c} and {0, 100, 101} & kept[name] == {0}
        if name == "decontamination":
            assert kept["ngram_join"] - kept[name] == {200}
    rows = docs.collect()
    assert all(r.lossless and len(r.ids) == r.n_pieces > 0 for r in rows) and {r.doc_id for r in rows} == kept["decontamination"]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()) == sorted(kept["pieces"])


def test_empty(spark, tmp_path):
    d = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_batches_are_bounded(spark):
    """Workers get whole texts in batches of bounded bytes; a smaller limit of the user stays."""
    import pyarrow as pa

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes], pa.int64())], names=["n"])

    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    docs = spark.createDataFrame(documents(), "doc_id long, text string, lang string, source string, n_chars long")
    try:
        corpus_pipeline.language(spark, docs, "")
        found = spark.range(0, 4000, 1, 1).selectExpr("repeat('x', 5000) text").mapInArrow(sizes, "n long").collect()
        assert max(r.n for r in found) < corpus_pipeline.BATCH_BYTES + 100_000
        spark.conf.set(name, "200b")
        corpus_pipeline.language(spark, docs, "")
        assert spark.conf.get(name) == "200b"
    finally:
        spark.conf.set(name, before)


def test_worker_memory_of_pieces():
    """4 MB of text in one batch are encoded and decoded in less than 100 MB besides."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from tracewell.llm import pieces

    vocab = SimpleNamespace(value=pieces.Vocabulary(pieces.default_model()))
    texts = [" ".join(f"word{(i * 131 + k) % 40_000} of a" for k in range(150)) for i in range(2000)]
    batch = pa.record_batch([pa.array(range(2000), pa.int64()), pa.array(texts), pa.array(range(2000), pa.int64())], names=["doc_id", "text", "row_key"])
    tracemalloc.start()
    try:
        for out in pieces.decoder(vocab)(pieces.encoder(vocab, "doc_id", 1)(iter([batch]))):
            assert out.column("decoded").equals(out.column("text"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    print("peak", peak / 1e6)
    assert peak < 100e6
