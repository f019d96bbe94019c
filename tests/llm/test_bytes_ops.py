"""Operators that work on one text at a time, against brute force."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tracewell.llm import decontam, langid, pieces, pii, sharding

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return WORD.findall(low(t))


def brute_contamination(docs, items):
    out = []
    for doc_id, text in docs:
        w, hit, seen = words(text), set(), set()
        for item, t in items:
            v = words(t)
            n = min(10, len(v))
            for i in range(len(v) - n + 1 if v else 0):
                for j in range(len(w) - n + 1):
                    if w[j : j + n] == v[i : i + n]:
                        hit.update(range(j, j + n))
                        seen.add(item)
        ids = ",".join(sorted(map(str, seen)))
        out.append((doc_id, len(w), len(hit), len(seen), hashlib.sha256(ids.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_cases(spark):
    ten = "Alpha beta, gamma delta epsilon ZETA eta theta iota kappa"
    items = [(1, ten + " lambda"), (2, "Überall ist es schön"), (3, None), (4, ""), (5, ten), (6, "x"), (7, "beta-max")]
    docs = [(1, f"so {ten.lower()} mu"), (2, "überall IST es schön; Überall ist es schon"), (3, None), (4, ""), (5, "betamax beta max x y"),
            (1, f"so {ten.lower()} mu"), (6, f"{ten} lambda " * 40), (7, "alphabeta " * 5000), (None, "x x")]
    d = spark.createDataFrame([(a, b, "l", 1) for a, b in docs], "doc_id long, text string, hits string, n_words int")
    b = spark.createDataFrame(items, "item_id long, text string")
    for size in (decontam.GROUP_BYTES, 40):
        got = sorted((tuple(r) for r in decontam.contamination(d, b, group_bytes=size).collect()), key=str)
        assert got == brute_contamination(docs, items)
    assert decontam.contamination(d.limit(0), b).count() == 0
    assert {r["n_hit"] for r in decontam.contamination(d, b.limit(0)).collect()} == {0}


def test_decontamination_on_table(spark):
    d, b = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = sorted((tuple(r) for r in decontam.op10_decontamination(spark, SF).collect()), key=str)
    docs, items = [(r.doc_id, r.text) for r in d.collect()], [(r.item_id, r.text) for r in b.collect()]
    # brute force by dictionary of windows
    wins = {}
    for i, t in items:
        v = words(t)
        n = min(10, len(v))
        for k in range(len(v) - n + 1 if v else 0):
            wins.setdefault(tuple(v[k : k + n]), set()).add(i)
    sizes = {len(k) for k in wins}
    want = []
    for i, t in docs:
        w, hit, seen = words(t), set(), set()
        for n in sizes:
            for j in range(len(w) - n + 1):
                if (found := wins.get(tuple(w[j : j + n]))) is not None:
                    hit.update(range(j, j + n))
                    seen |= found
        want.append((i, len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(map(str, seen))).encode()).hexdigest(), bool(hit)))
    assert got == sorted(want, key=str)
    assert sum(r[5] for r in got) > 0


def test_wu_manber_finds_all():
    rnd = random.Random(5)
    pats = sorted({bytes(rnd.choice(b"ab ") for _ in range(rnd.choice([1, 2, 3, 5, 13, 40, 70]))) for _ in range(60)})
    text = bytes(rnd.choice(b"ab ") for _ in range(5000)) + pats[-1] * 5
    import numpy as np

    got = sorted(decontam.WuManber(pats).search(np.frombuffer(text, np.uint8)))
    want = sorted((m.start(), i) for i, p in enumerate(pats) for m in re.finditer(b"(?=" + re.escape(p) + b")", text))
    assert got == want


def test_sharding_laws(spark):
    rows = [(i, "hot" if i % 3 == 0 else f"text ä {i}", "x") for i in range(1000)] + [(None, None, "x"), (5, "text ä 5", "x"), (5, "text ä 5", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    for salt in (200_000, 37):
        got = sharding.shard(d, shards=7, rows_per_salt=salt).collect()
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in rows)
        per = {}
        for r in got:
            per.setdefault(r.shard, []).append(r.slot)
        assert set(per) == set(range(7)) and all(sorted(v) == list(range(len(v))) for v in per.values())
        assert max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert sharding.shard(d.limit(0)).count() == 0
    few = sharding.shard(d.limit(3), shards=40).collect()
    assert len(few) == 3 and all(r.slot == 0 for r in few)


def brute_ring(cells, shards, vnodes):
    """Row by row: clockwise from its cell to the first node whose shard has room."""
    nodes = sharding.ring(shards, vnodes)
    n = len(cells)
    room = [n // shards] * shards
    for x in list(dict.fromkeys(x for _, x in nodes))[: n % shards]:
        room[x] += 1
    waiting, owner, by_cell = [], {}, {}
    for k, c in enumerate(cells):
        by_cell.setdefault(c, []).append(k)
    for lap in range(3):
        for cell, shard in nodes:
            if lap == 0:
                for c in sorted(c for c in by_cell if c <= cell):
                    waiting += by_cell.pop(c)
            while waiting and room[shard]:
                owner[waiting.pop(0)] = shard
                room[shard] -= 1
        if lap == 0:
            for c in sorted(by_cell):
                waiting += by_cell.pop(c)
    return owner


def test_sharding_walk_equals_brute_force():
    rnd = random.Random(4)
    for shards, vnodes, n in ((3, 2, 50), (7, 5, 200), (40, 8, 30), (5, 3, 0)):
        cells = sorted(rnd.choice([rnd.randrange(65536), 500, 65535]) for _ in range(n))
        counts = {c: cells.count(c) for c in cells}
        at = {}
        for c, lo, hi, s, slot in sharding.walk(counts, shards, vnodes):
            at |= {(c, k): (s, slot + k - lo) for k in range(lo, hi)}
        got = [at[c, k - cells.index(c)] for k, c in enumerate(cells)]
        want = brute_ring(cells, shards, vnodes)
        assert [s for s, _ in got] == [want[k] for k in range(n)] and len(set(got)) == n


def test_sharding_moves_little():
    def cells(n):
        return [zlib.crc32(f"k{i}".encode()) % 65536 for i in range(n)]

    def owner(c, shards=40):
        counts = {x: c.count(x) for x in set(c)}
        return {(cell, k): s for cell, lo, hi, s, _ in sharding.walk(counts, shards, 64) for k in range(lo, hi)}

    rows = cells(6000)
    a = owner(rows)
    more = owner(rows + cells(6060)[6000:])
    assert sum(a[k] != more[k] for k in a) < 0.1 * len(a)
    grown = owner(rows, 41)
    assert sum(a[k] != grown[k] for k in a) < 0.15 * len(a)


def test_sharding_is_the_same_again(spark):
    """Slots of rows with equal ids and different texts do not depend on partitions; the query runs over its table."""
    rows = [(i % 5 if i % 2 else None, f"text {i % 7}", i) for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string, slot int")
    one, two = (sorted((str(r.doc_id), r.text_crc32, r.shard, r.slot) for r in sharding.shard(x, shards=6, rows_per_salt=9).collect()) for x in (d, d.repartition(5)))
    assert one == two
    got = sharding.op4_sharding(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count() and {r.shard for r in got} == set(range(40))


def brute_phrases(text, sample):
    """Greedy longest-match parsing by substring search."""
    t, n, i = langid.collapse(text), 0, 0
    while i < len(t):
        j = i + 1
        while j <= len(t) and t[i:j] in sample:
            j += 1
        i = max(i + 1, j - 1)
        n += 1
    return n


def test_language_phrases_equal_brute_force(monkeypatch):
    monkeypatch.setattr(langid, "PIECE", 16)
    rnd = random.Random(2)
    han = "".join(chr(0x4E00 + rnd.randrange(900)) for _ in range(3000))
    samples = {"de": "der Hund und die Katze laufen über die Straße. " * 3, "en": "the dog and the cat run across the street " * 3, "zh": han}
    texts = ["Der Hund läuft, und der Kater auch!", "the cat sat 12 times", "", "¿qué?", "über die " * 70, "x", "...", "  a", samples["de"] * 2, han[100:400] + "the dog and" + han[7:60], "я не знаю"]
    texts += ["".join(rnd.choice("derundthecat \u4e00\u4e05") for _ in range(rnd.randrange(200))) for _ in range(60)]
    for table in (langid.TABLE, 4000):  # with few letters in the table the others are found by key
        m = langid.Model(samples, table)
        symbols, sizes, letters = m.symbols(texts)
        got = m.phrases(symbols, sizes)
        for k, lang in enumerate(m.langs):
            assert got[k].tolist() == [brute_phrases(t, langid.collapse(samples[lang])) for t in texts]
        assert letters.tolist() == [any(c.isalpha() for c in t) for t in texts]
        pred, score = m.predict(texts)
        assert pred[:3] == ["de", "en", "und"] and pred[6] == "und" and pred[9] == "zh" and ((score >= 0) & (score <= 1)).all()
    assert langid.Model({}).predict(["a"])[0] == ["und"]


def test_language_learns_only_what_it_may(spark):
    """Held-out rows, lang, source and ids are no inputs; samples stay in their bounds."""
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    other = d.withColumn("lang", F.when(langid.held_out(), "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    model = langid.fit(other)
    assert "xx" not in model.langs and model.langs == langid.fit(d).langs
    lost = d.withColumn("text", F.when(langid.held_out(), "zzz qqq").otherwise(F.col("text")))
    assert (langid.fit(lost).table == model.table).all()
    blank = {r.doc_id: r.lang_pred for r in langid.identify(d.withColumn("lang", F.lit(None).cast("string")), model).collect()}
    assert blank == {r.doc_id: r.lang_pred for r in langid.identify(d, model).collect()}
    small = langid.fit(d, sample_docs=3, sample_chars=500)
    assert (small.weight <= 9).all()
    clash = d.limit(20).withColumn("__lang", F.lit("mine"))
    assert {r["__lang"] for r in langid.identified(clash).collect()} == {"mine"}


def test_language_edge_rows(spark):
    rows = [(1, None, "de", 0), (None, "der die das", None, 0), (3, "", "en", 0), (4, "the cat and the dog", "en", 0), (4, "the cat and the dog", "en", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    got = langid.identify(d, langid.fit(d)).collect()
    assert len(got) == 5 and all(r.lang_pred in ("en", "und") for r in got)
    assert langid.identify(d.limit(0), langid.fit(d.limit(0))).count() == 0


def test_language_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.op7_language_id(spark, sf).join(d.select("doc_id", "lang"), "doc_id").filter("held_out")
    right = got.filter("lang_pred = lang").count() / got.count()
    assert right >= 0.97, right


def brute_base(text):
    """The four patterns as they stand."""
    text, out = text or "", []
    out += [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[ -]", "", m[0])
        s = sum((int(c) * 2 - 9 if int(c) * 2 > 9 else int(c) * 2) if k % 2 else int(c) for k, c in enumerate(d[::-1]))
        if 16 <= len(d) <= 19 and s % 10 == 0:
            out.append(("card", m.start(), m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def test_base_spans_equal_patterns():
    rnd = random.Random(3)
    texts = ["", "a@b.c@d.e f@@g.h", "1.2.3.4.5.6.7.8 300.1.1.1", "4111 1111-1111 1111", "+49 (30) 123-456.", "ä é@x.y a@x..y a@-.b", "٣.٣.٣.٣"]
    texts += ["".join(rnd.choice("ab@.-+ 1234 ()%é") for _ in range(60)) for _ in range(3000)]
    for t in texts:
        assert [x[:3] for x in pii.base_spans(t)] == brute_base(t), t
    import time

    t0 = time.time()
    for t in ("a" * 200_000, "1" * 200_000, "+" * 200_000, "+1" + " " * 200_000, "a@" * 100_000):
        pii.base_spans(t)
    assert time.time() - t0 < 5


def test_pii_query(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
        for r in pii.op3_pii(spark, sf).collect():
            base = brute_base(docs[r.doc_id])
            shown = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            assert r.base_sha256 == hashlib.sha256(shown.encode()).hexdigest()
            assert r.spans.startswith(shown) and [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x[0] == k for x in base) for k in pii.KINDS]


def test_disclosing_terms(spark):
    rows = [(i, f"Herr Grünwald schreibt an boss@x.org vom Dienst {i}", "x") for i in range(5)] + [(100 + i, f"nichts schreibt vom Dienst hier {i}", "x") for i in range(200)]
    rows += [(None, None, "x"), (7, "", "x")]
    d = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = {r.doc_id: r for r in pii.sanitise_spans(d).collect()}
    text = rows[0][1]
    terms = {text[t.start : t.stop]: t.action for t in got[0].terms}
    assert terms == {"Grünwald": "remove", "Herr": "remove", "an": "remove"}
    assert got[100].terms == [] and got[None].base == []
    assert pii.apply_spans(text, [tuple(b) for b in got[0].base], [tuple(t) for t in got[0].terms]) == "  schreibt  <email> vom Dienst 0"
    assert pii.sanitise_spans(d.limit(0)).count() == 0


def test_terms_of_rare_entities(spark):
    rows = [(0, "Frau Einmalig wohnt hier unter one@x.org"), (1, "Herr Zweimal wohnt hier unter two@x.org"), (2, "Herr Zweimal wohnt hier unter two@x.org")]
    rows += [(100 + i, f"Frau oder Herr wohnt hier unter {i}") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: {rows[r.doc_id][1][t.start : t.stop]: t.action for t in r.terms} for r in pii.sanitise_spans(d).collect() if r.terms}
    assert got == {0: {"Einmalig": "generalise"}, 1: {"Zweimal": "remove"}, 2: {"Zweimal": "remove"}}


def brute_terms(docs):
    """Terms and actions of all documents, from the formulas as they stand."""
    from math import log

    n = len(docs)
    base = {i: brute_base(t) for i, t in docs}
    value = {"email": str.lower, "ip": lambda x: ".".join(str(int(p)) for p in x.split(".")), "card": lambda x: re.sub("[ -]", "", x), "phone": lambda x: re.sub("[^0-9]", "", x)}
    entities = {i: {(k, value[k](t[a:b])) for k, a, b in base[i]} for i, t in docs if t}
    found = {i: [(m.start(), m.end(), low(m[0])) for m in WORD.finditer(low(t))] for i, t in docs}
    free = {i: [x for x in found[i] if not any(a < x[1] and x[0] < b for _, a, b in base[i])] for i, _ in docs}
    df, df_e, joint = {}, {}, {}
    for i, _ in docs:
        for w in {x[2] for x in found[i]}:
            df[w] = df.get(w, 0) + 1
        for e in entities.get(i, ()):
            df_e[e] = df_e.get(e, 0) + 1
            for w in {x[2] for x in free[i]}:
                joint[e, w] = joint.get((e, w), 0) + 1
    rate = {}
    for (e, w), j in joint.items():
        if df_e[e] < n:
            given = min(1.0, (j + 0.5 * df_e[e] / n) / (df[w] + 0.5))
            rate[w] = max(rate.get(w, 0), 1 + log(given) / log(n / df_e[e]))
    return {i: [(a, b, "remove" if rate[w] >= 0.95 else "generalise") for a, b, w in free[i] if rate.get(w, 0) >= 0.8] for i, _ in docs}


def test_terms_equal_brute_force(spark):
    rnd = random.Random(9)
    words_ = [f"w{k}" if k % 3 else str(100 + k) for k in range(60)] + ["Äpfel", "x", "Müller", "DE-77"]
    docs = []
    for i in range(120):
        w = [rnd.choice(words_) for _ in range(rnd.randrange(1, 14))]
        if i % 4 == 0:
            k = rnd.randrange(4)
            w.insert(rnd.randrange(len(w)), ["a@b.org", "c@d.org, 10.0.0.1", "+49 30 1234567", "x@y.de"][k])
            w += [f"Tie{k}", f"{k}77", "Often"][: rnd.randrange(1, 4)]
        docs.append((i, " ".join(w)))
    docs += [(500, None), (501, "")]
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    got = pii.sanitise(rows, group_keys=7).collect()
    want = brute_terms(docs)
    assert sum(map(len, want.values())) > 20
    for r in got:
        assert sorted((t.start, t.stop, t.action) for t in r.terms) == sorted(want[r.doc_id]), r
        text = dict(docs)[r.doc_id]
        assert r.text == (text and pii.apply_spans(text, [tuple(b) for b in r.base], [tuple(t) for t in r.terms]))
    assert pii.apply_spans("Herr Kern 12 a1 und", [], [(5, 9, "generalise"), (10, 12, "generalise"), (13, 15, "generalise"), (16, 19, "generalise")]) == "Herr <name> <number> <code> <word>"


def test_terms_in_whole_documents(spark):
    far = "Grünwald é " + "wohnt hier " * 20
    rows = [(i, f"{far}boss@x.org und Grünwald, grünwald") for i in range(5)] + [(5, "é Grünwald ohne alles")]
    rows += [(100 + i, "wohnt hier ohne alles und sonst é") for i in range(300)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for group_keys in (1 << 20, 1):
        got = {r.doc_id: [rows[r.doc_id][1][t.start : t.stop] for t in r.terms] for r in pii.sanitise_spans(d, group_keys=group_keys).collect() if r.terms}
        assert got == {**{i: ["Grünwald", "Grünwald", "grünwald"] for i in range(5)}, 5: ["Grünwald"]}


TEXTS = ["", " ", "  two  blanks ", "Hello world\nnext ▁line", "Überall ist es schön 你好 🙂 ​", "a" * 500, "\n\n", "ñandú-" * 40, "\x00\x01", None, "▁"]


def test_pieces_round_trip(spark):
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "null key", "x"), (0, "", "x")], "doc_id long, text string, ids string")
    got = pieces.decode(pieces.encode(d)).collect()
    assert len(got) == len(TEXTS) + 2
    assert all(r.decoded == r.text for r in got)
    assert [r.ids for r in got if r.text is None] == [None] and all(r.ids == [] for r in got if r.text == "")
    again = {str(r.doc_id): r.ids for r in pieces.encode(d.repartition(3)).collect()}
    assert all(again[str(r.doc_id)] == r.ids for r in got)
    assert sorted(map(str, pieces.round_trip(d).collect())) == sorted(map(str, got))
    assert pieces.encode(d.limit(0)).count() == 0


def test_pieces_are_drawn_from_the_posterior():
    """Frequencies of whole segmentations against enumeration of all paths."""
    import numpy as np

    v = pieces.Vocabulary(pieces.default_model())
    word = b" hello"
    ids = {s: i for i, s in enumerate(v.strings) if v.weight[i] > 0}

    def paths(i):
        if i == len(word):
            yield (), 1.0
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in ids:
                k = ids[word[i:j]]
                for rest, w in paths(j):
                    yield (k, *rest), v.weight[k] * w

    want = dict(paths(0))
    total = sum(want.values())
    n = 40_000
    buf = np.frombuffer(word[1:] * n, np.uint8)
    out, cuts = v.encode(buf, np.arange(n + 1) * 5, np.arange(n, dtype=np.int64))
    from collections import Counter

    seen = Counter(tuple(out[a:b].tolist()) for a, b in zip(cuts, cuts[1:]))
    assert set(seen) <= set(want)
    for path, w in want.items():
        p = w / total
        assert abs(seen[path] / n - p) < 5 * (p * (1 - p) / n) ** 0.5 + 1e-4


def test_long_units_are_drawn_from_their_lattice():
    """Text without blanks: exact posterior of every border, far beyond the short units."""
    import numpy as np

    v = pieces.Vocabulary(pieces.default_model())
    word = "Donaudampfschifffahrtsgesellschaftskapitänsmützenabzeichenfabrikantinnen中文字" * 3
    raw = b" " + word.encode()
    known = {v.strings[i]: v.weight[i] for i in v.ranks}
    n = len(raw)

    def edges(i):
        point = next(k for k in (1, 2, 3, 4) if i + k == n or raw[i + k] & 0xC0 != 0x80)
        out = {i + k: known[raw[i : i + k]] for k in range(1, min(v.longest, n - i) + 1) if raw[i : i + k] in known}
        out.setdefault(i + point, v.byte_weight**point)
        return out

    forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
    forward[0] = backward[n] = 1.0
    scale = 10.0  # for each byte: no underflow
    for i in range(n):
        for j, w in edges(i).items() if forward[i] else ():
            forward[j] += forward[i] * w * scale ** (j - i)
    for i in reversed(range(n)):
        if forward[i]:
            backward[i] = sum(w * scale ** (j - i) * backward[j] for j, w in edges(i).items())
    want = np.array([forward[i] * backward[i] / forward[n] for i in range(n + 1)])
    m = 3000
    buf = np.frombuffer(word.encode() * m, np.uint8)
    offsets = np.arange(m + 1) * len(word.encode())
    ids, cuts = v.encode(buf, offsets, np.arange(m, dtype=np.int64))
    got = np.zeros(n + 1)
    spelt = set(v.byte_ids.tolist())
    for k in range(m):
        at = 0
        for i in ids[cuts[k] : cuts[k + 1]].tolist():
            at += len(v.strings[i])
            got[at] += 1
    inner = [i for i in range(1, n) if raw[i] & 0xC0 != 0x80]
    assert abs(got[inner] / m - want[inner]).max() < 0.05
    assert v.decode(ids, cuts)[0].tobytes() == word.encode() * m and spelt


def test_pieces_query(spark):
    got = pieces.op9_pieces(spark, SF)
    assert got.filter("not lossless").count() == 0 and got.agg(F.sum("n_pieces")).first()[0] > 0


@pytest.mark.parametrize("n", [1, 2, 5])
def test_shingles(n):
    import numpy as np

    from tracewell.llm.bytesops import shingle_hashes, word_bounds, word_hashes

    texts = ["a b c d e f a b c d e", "", "x y", "a b c d e"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    s, e, row = word_bounds(buf, off)
    h, r = shingle_hashes(word_hashes(buf, s, e), row, n)
    want = []
    for i, t in enumerate(texts):
        w = t.split()
        if w:
            want += [(i, tuple(w[k : k + n])) for k in range(max(1, len(w) - n + 1))]
    assert [x[0] for x in want] == r.tolist()
    names = {}
    assert all(names.setdefault(x[1], y) == y for x, y in zip(want, h.tolist()))
    assert len(set(names.values())) == len(names)
