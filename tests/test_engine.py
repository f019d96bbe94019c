"""The whole method, its operators without SQL, sources, connectors and the stream."""

import json

import pytest
from pyspark.sql import functions as F

from tracewell.functions import names, quotes, spans
from tracewell.operators import embeddings, inference, scoring, verify
from tracewell.operators.words import same_word
from tracewell.plans import align as plan
from tracewell.plans.variants import VARIANTS
from tracewell.sources import connectors, documents
from tracewell.streaming import stream

ARTICLE = """# Neuer Hof in Westerfeld

Die Gemeinde Westerfeld baut bis 2027 einen neuen Hof für 5,3 Millionen Euro. Das Gebäude liegt am alten Markt und bekommt 40 Plätze.

„Das ist für uns und unsere Kollegen aus dem Kreis ein großer Schritt“, sagt Bürgermeister Karl Benno, Vorsitzender des Vereins. „Wir werden die Bauern aus der Umgebung einladen und gemeinsam planen.“

Der Bau soll im Mai beginnen. Wie teuer wird das alles am Ende wirklich?"""
TRANSCRIPT = """Westerfeld baut bis zweitausendsiebenundzwanzig einen neuen Hof für fünf Komma drei Millionen Euro am alten Markt mit vierzig Plätzen. Karl Benno will die Bauern aus der Umgebung einladen und gemeinsam planen. Das Gebäude liegt am alten Markt und bekommt 60 Plätze. Ganz anderes Wetter gab es gestern im fernen Süden."""


@pytest.fixture(scope="module")
def traced(spark):
    def infer():
        return lambda pairs: [{"entailment": 0.1, "neutral": 0.8, "contradiction": 0.1} if "planen" in h else {"entailment": 0.9, "neutral": 0.05, "contradiction": 0.05} for _, h in pairs]

    pairs = spark.createDataFrame([("p", ARTICLE, TRANSCRIPT), ("leer", "", "Ein Satz ohne Quelle.")], "pair_id string, article string, transcript string")
    return {r.pair_id: r.asDict(True) for r in plan.trace(pairs, infer=infer).collect()}


def test_run_document(traced):
    doc = traced["p"]
    s, c = doc["article"]["sentences"], doc["transcript"]["claims"]
    assert all(doc["article"]["text"][x["start"] : x["end"]] == x["text"] for x in s) and s[0]["block"] == "heading"
    assert all(doc["transcript"]["text"][x["start"] : x["end"]] == x["text"] for x in c)
    assert [x["id"] for x in c] == ["c1", "c2", "c3", "c4"] and doc["meta"]["titel"] == "Neuer Hof in Westerfeld"
    assert c[0]["relation"] == "aggregiert" and [q["sentence"] for q in c[0]["sources"]] == ["s2", "s3"]
    assert {(e["norm"], e["status"]) for e in c[0]["entities"]} >= {("2027", "match"), ("5300000 EUR", "match"), ("40", "match")}
    assert "Verdichtet aus s2 + s3" in c[0]["note"] and "Anker 2027 eindeutig in s2" in c[0]["note"]
    # the quoted sentence names nobody: its speaker's context covers the name
    assert c[1]["sources"][0]["sentence"] == "s5" and c[1]["relation"] == "bedeutung_verschoben" and "bedeutung_verschoben" in c[1]["flags"]
    assert c[2]["flags"][0] == "zahlkonflikt" and [e for e in c[2]["entities"] if e["status"] == "konflikt"][0]["quelle_norm"] == "40"
    assert c[2]["wortlaut"]["aenderungen"] == [{"claim": "60", "quelle": "40", "nah": False, "aehnlichkeit": 0.5}]
    assert c[3]["relation"] == "keine_quelle" and c[3]["sources"] == [] and c[3]["confidence"] > 0.55
    for x in c:
        for q in x["sources"]:
            own = next(y for y in s if y["id"] == q["sentence"])
            assert all(own["start"] <= a < b <= own["end"] for a, b in q["spans"]) and q["spans"] == sorted(q["spans"])
    assert traced["leer"]["transcript"]["claims"] == []


def test_stage_switches():
    assert not any([(s := plan.Stages.without(["0", "wortlaut"])).anchors, s.numbers, s.wording]) and s.cover and s.split
    assert plan.Stages.without(["1.5", "2_embeddings", ""]).named()["1.5_restabdeckung"] is False
    with pytest.raises(KeyError):
        plan.Stages.without(["9"])
    assert len(VARIANTS) == 22 and VARIANTS["E_max_quellen"].most == 5


def test_quotes():
    told = [("Rede im Rathaus", 0), ("„Das freut mich und meine Kollegen aus dem Kreis“, sagt Anna Berg, Leiterin der Schule.", 1), ("„Wir planen weiter.", 1), ("Und wir bleiben dran.“", 1), ("Anna Berg kam spät.", 1), ("„Ich auch.“", 2)]
    assert quotes.blocks(quotes.read(told)) == [[1, 2, 3], [5]]
    assert quotes.contexts(told) == ["", "", *["Anna Berg, Leiterin der Schule Kollegen aus dem Kreis"] * 2, "", "Anna Berg, Leiterin der Schule"]
    named = [("Anna Berg", 0, 9)]
    assert quotes.attribution("Anna Berg erklärt dazu: „Nein“", named) == "Anna Berg"
    assert quotes.attribution("Anna Berg, die gestern kam", named) is None and quotes.balance("„a“ «b") == (1, True) and quotes.contexts([]) == []


def test_evidence():
    t = "Laut Feuerwehr konnte es zu einer Geruchsbelästigung kommen."
    assert [t[a:b] for a, b in spans.evidence("Feuerwehr meldet Geruchsbelästigung", t)] == ["Feuerwehr", "Geruchsbelästigung"]
    assert spans.evidence("ganz anderes", t) == [(0, len(t))] and spans.evidence(None, None) == [(0, 0)]
    assert spans.evidence("Feuerwehr", t, [(0, 4), (5, 8)]) == [(0, 4), (5, 14)]


def test_word_forms(spark):
    cases = [("Nordfriesland", "Nordfrieslands", True), ("Lippstädter", "Lippstadt", True), ("grünen", "grüner", True), ("Münchner", "München", True), ("Langenhorn", "Langenharm", False), ("Munster", "Münster", None), ("Munsters", "Munstera", True), ("Bau", "Bad", None)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string")
    assert [r.s for r in rows.select(same_word(F.col("a"), F.col("b")).alias("s")).collect()] == [x for *_, x in cases]


def test_places_and_codes(spark):
    text = spark.createDataFrame([("p", "Die Pläne für ein XXL-Rechenzentrum in Langenhorn. Die Gesellschaft Nordfriesland (EGNF) vermarktet Typ 212CD.")], "pair_id string, text string")
    claims = spark.createDataFrame([("p", 0, "Ein XL-Rechenzentrum in Langenharm"), ("p", 1, "Die EGFN und zwei-eins-zwei-C-D"), ("p", 2, "Nordfrieslands EGNF, XXL, QQQQQQ")], "pair_id string, ci int, text string")
    got = sorted((r.ci, r.code, r.status, r.nearest) for r in verify.checked_codes(claims, text).collect())
    assert got == [(0, "XL", "konflikt", "XXL"), (1, "EGFN", "konflikt", "EGNF"), (2, "QQQQQQ", "unbelegt", None)]
    names_ = spark.createDataFrame([("p", 0, "Langenharm"), ("p", 2, "Nordfrieslands"), ("p", 2, "Xyzw")], "pair_id string, ci int, name string")
    places = verify.checked_places(names_, text)
    assert sorted((r.ci, r.word, r.status, r.nearest) for r in places.collect()) == [(0, "Langenharm", "konflikt", "Langenhorn"), (2, "Xyzw", "unbelegt", None)]
    flags = {r.ci: r.flags for r in verify.identifier_flags(places, verify.checked_codes(claims, text)).collect()}
    assert flags == {0: ["kuerzel_konflikt", "ort_konflikt"], 1: ["kuerzel_konflikt"], 2: ["ident_unbelegt"]}


def test_long_words_are_near_too(spark):
    a, b = "a" * 24 + "bc", "a" * 24
    asked = spark.createDataFrame([(1, a), (1, "x" * 30)], "pair_id int, low string")
    known = spark.createDataFrame([(1, b, b.upper()), (1, "x" * 29, "X" * 29), (1, a, a)], "pair_id int, other string, spelling string")
    assert sorted((r.low, r.nearest) for r in verify.nearest_spellings(asked, known).collect()) == [(a, b.upper()), ("x" * 30, "X" * 29)]


def test_embeddings(spark):
    def make():
        return lambda texts, query: [[1.0, float(len(t)), 0.5 * query] for t in texts]

    sents = spark.createDataFrame([("p", s, i, "x" * n) for s, i, n in (("claim", 0, 3), ("claim", 1, 9), ("source", 0, 3), ("source", 1, 30))], "pair_id string, side string, idx int, text string")
    got = {(r.ci, r.si): r.emb for r in embeddings.similarities(embeddings.embedded(sents, make, batch=1)).collect()}
    assert len(got) == 4 and min(got.values()) == 0.0 and max(got.values()) == 1.0
    assert embeddings.prefixed(["a"], True, embeddings.style_of("multilingual-e5-base")) == ["query: a"] and embeddings.prefixed(["a"], False, embeddings.style_of("x-instruct")) == ["a"]
    assert embeddings.prefixed(["a"], True, embeddings.style_of("local-bge-m3")) == ["a"]


def test_inference_helpers(spark):
    assert inference.label_order({0: "contradiction", 1: "neutral", 2: "entailment"}) == (2, 1, 0)
    assert inference.label_order({0: "LABEL_0"}, lambda p, h: [0.1, 0.9, 0.0] if p == h else [0.2, 0.1, 0.7]) == (1, 0, 2)
    rows = spark.createDataFrame([("es kam niemand",), ("sie nannte",), ("dabei kein Wort",)], "t string")
    got = rows.select(inference.negated(F.col("t")).alias("n"), inference.has_anaphor(F.col("t")).alias("a")).collect()
    assert [(r.n, r.a) for r in got] == [(True, True), (False, True), (True, True)]
    assert rows.select(scoring.percent(F.lit(0.125)).alias("p"), scoring.comma(F.lit(0.4321)).alias("c")).first() == ("12 %", "0,43")


def test_documents(spark, tmp_path):
    doc = {"meta": {"titel": "t"}, "article": {"text": "A.", "sentences": []}, "transcript": {"text": "B.", "claims": []}}
    for run, name, body in (("voll", "a", json.dumps(doc)), ("alt", "b", json.dumps(doc)), ("alt", "c", "{broken"), ("alt", "d", json.dumps({"meta": {}}))):
        (tmp_path / "r" / run).mkdir(parents=True, exist_ok=True)
        (tmp_path / "r" / run / f"{name}.json").write_text(body)
    assert sorted((r.pair_id, r.run) for r in documents.runs(spark, f"{tmp_path}/r/*/*.json").collect()) == [("a", "voll"), ("b", "alt")]
    assert sorted((r.file[-6:], r.reason) for r in documents.unreadable(spark, f"{tmp_path}/r/*/*.json").collect()) == [("c.json", "broken"), ("d.json", "no texts")]
    assert [(r.run, r.place, r.n) for r in documents.run_folders(spark, f"{tmp_path}/r").orderBy("place").collect()] == [("voll", 0, 1), ("alt", 1, 1)]
    gold = [{"paar": p, "split": s, "transkript_hash": p, "eintraege": [{"satz": "t1", "geprueft": g, "notwendig": ["s1"]}]} for p, s, g in (("x", "dev", True), ("y", "test", True), ("z", "dev", False))]
    (tmp_path / "g").mkdir()
    for g in gold:
        (tmp_path / "g" / f"{g['paar']}.json").write_text(json.dumps(g))
    assert [r.paar for r in documents.labels(spark, f"{tmp_path}/g", "dev").collect()] == ["x"]
    assert [r[0] for r in documents.other_split(spark, f"{tmp_path}/g", "dev").collect()] == ["y"]
    pairs = spark.createDataFrame([("1", "a"), ("2", "b")], "pair_id string, v string")
    target = f"{tmp_path}/out"
    for ids in (["1", "2"], []):
        assert sorted(r.pair_id for r in documents.unfinished(pairs, spark, target).collect()) == ids
        documents.align_all(pairs, target, lambda p: p)
    assert documents.written(spark, target).count() == 2
    asked = documents.requested(spark.createDataFrame([(" a ", "b"), ("", "b"), ("a" * 20, "b")], "article string, transcript string"), most=10)
    assert [(r.status, r.error is None) for r in asked.collect()] == [(200, True), (400, False), (400, False)]
    documents.log_metrics(spark.createDataFrame([(0.5,)], "f1 double"), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").columns == ["f1", "zeit"]


def test_drafts(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(f"{tmp_path}/cp")
    schema = "pair_id string, satz int, hash string, reviewed boolean, relation string"
    target = f"{tmp_path}/drafts"
    old = [("p", 0, "h", True, "direkt"), ("p", 1, "h", False, "direkt"), ("q", 0, "h", True, "alt"), ("r", 0, "h", False, "alt")]
    documents.write_drafts(spark.createDataFrame(old, schema), target)
    new = spark.createDataFrame([("p", 0, "h", False, "neu"), ("p", 1, "h", False, "neu"), ("p", 2, "h", False, "neu"), ("r", 0, "other", False, "neu")], schema)
    with pytest.raises(FileExistsError):
        documents.write_drafts(new, target)
    documents.write_drafts(new, target, update=True)
    got = sorted((r.pair_id, r.satz, r.hash, r.reviewed, r.relation) for r in spark.read.schema(schema).json(target).collect())
    assert got == [("p", 0, "h", True, "direkt"), ("p", 1, "h", False, "neu"), ("p", 2, "h", False, "neu"), ("q", 0, "h", True, "alt"), ("r", 0, "h", False, "alt")]


def test_connectors():
    now, slept = [0.0], []

    def sleep(s):
        slept.append(round(s, 3))
        now[0] += s

    pacer = connectors.Pacer(lambda: now[0], sleep)
    sent = []

    def post(payload, key):
        sent.append((payload["input"], key))
        if len(sent) == 2:
            return 429, {"retry-after": "5", "ratelimit-reset": "2"}, {}
        return 200, {"x-ratelimit-limit-second": "1"}, {"data": [{"index": i, "embedding": [len(t)]} for i, t in reversed(list(enumerate(payload["input"])))]}

    embed = connectors.patient(connectors.remote_embed(post, "bge-m3", " k ", pacer, batch=2), pacer)
    assert embed(["a", "bbb", "cc"], True) == [[1], [3], [2]] and sent[0] == (["a", "bbb"], "k") and len(sent) == 4
    assert 5.0 in slept  # the service's own time: reset 2, and 3 more
    with pytest.raises(connectors.ModelError):
        connectors.remote_embed(post, "m", "")
    pacer.limits = {"x-ratelimit-remaining-day": "0"}
    with pytest.raises(connectors.QuotaError):
        pacer.check_quota()

    def trace(model):
        if model == "remote":
            raise connectors.ModelError("down")
        return model

    assert connectors.traced_with_fallback(trace, "remote", "local") == ("local", True)
    assert connectors.traced_with_fallback(trace, "other", None) == ("other", False)
    with pytest.raises(connectors.ModelError):
        connectors.traced_with_fallback(trace, "remote", None)


def test_stream(spark, tmp_path):
    rows = [("p", "source", 0, "Der Hof in Westerfeld wird neu gebaut. Das Dach ist rot."), ("p", "claim", 1, "Der Hof wird neu gebaut."), ("q", "source", 0, "Nichts davon."), ("p", "claim", 2, "Das Dach ist rot.")]
    schema = "pair_id string, side string, ord int, text string"
    (tmp_path / "in").mkdir()
    for part in (rows[:3], rows[3:]):  # the pair's turns come in two batches
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        stream.align_stream(source, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = sorted(tuple(r) for r in stream.aligned(spark, f"{tmp_path}/out").select("pair_id", "ci", "si").collect())
    assert got == sorted(tuple(r) for r in plan.align(spark.createDataFrame(rows, schema)).select("pair_id", "ci", "si").collect()) and len(got) == 2


def test_names():
    assert names.name_matches("Kraft", "Sabine Kraft") and not names.name_matches("Ehrler", "Ehrle")
