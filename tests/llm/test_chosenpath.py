"""N-gram join against the Jaccard similarity of all pairs, and components against a plain search."""

import random
import re

from tracewell.llm import chosenpath
from tracewell.llm.components import components

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def shingles(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    s = [shingles(t) for _, t in rows]
    near = [[b for b in range(len(rows)) if a != b and s[a] and s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])] for a in range(len(rows))]
    out = []
    for a in range(len(rows)):
        seen, todo = {a}, [a]
        while todo:
            for b in near[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        out.append((rows[a][0], len(near[a]), min(rows[b][0] for b in seen)))
    return sorted(out)


def made(seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(40):
        w = [rnd.choice("die der und of the a b c d e f g".split()) + str(rnd.randint(0, 9)) for _ in range(rnd.randint(1, 80))]
        for _ in range(rnd.choice([1, 1, 3, 12])):
            v = list(w)
            for _ in range(rnd.choice([0, 0, 1, 2])):
                v[rnd.randrange(len(v))] = "neu" + str(rnd.randint(0, 99))
            rows.append((len(rows), rnd.choice([" ", ", "]).join(v)))
    rnd.shuffle(rows)
    return rows + [(1000, None), (1001, ""), (1002, "..."), (1003, "")]


def test_against_brute_force(spark, monkeypatch):
    rows = made(3)
    d = spark.createDataFrame([(a, b, 1, 2) for a, b in rows], "doc_id long, text string, cls int, size int")
    for node, part, stray, chunk in ((256, 4096, 1024, 1024), (6, 12, 2, 4)):
        for name, value in (("NODE", node), ("PART", part), ("STRAY", stray), ("CHUNK", chunk)):
            monkeypatch.setattr(chosenpath, name, value)
        got = sorted((r.doc_id, r.n_links, r.component_id) for r in chosenpath.near_duplicates(d).collect())
        assert got == brute(rows)


def near_copies(n, seed=5):
    rnd = random.Random(seed)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2])):
            w[rnd.choice([0, 1, 2, 57, 58, 59, 30])] = f"x{i}"
        rows.append((i, " ".join(w)))
    return rows


def test_large_group_of_near_copies(spark, monkeypatch):
    """Exact results, and candidate edges in proportion to the group, though its nodes are beyond one task."""
    monkeypatch.setattr(chosenpath, "PART", 300)
    monkeypatch.setattr(chosenpath, "STRAY", 40)
    edges = {}
    for n in (600, 1200):
        rows = near_copies(n)
        d = spark.createDataFrame(rows, "doc_id long, text string")
        s = chosenpath.sketches(d, 5, chosenpath.root_tokens(0.8)).filter("n_shingles > 0").dropDuplicates(["cls"])
        edges[n] = chosenpath.candidates(chosenpath.written(s, "test"), 0.8).count()
    assert edges[1200] < 2.5 * edges[600] and edges[1200] < 4 * chosenpath.runs_for(0.8) * 1200
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in chosenpath.near_duplicates(spark.createDataFrame(near_copies(900), "doc_id long, text string")).collect())
    assert got == brute(near_copies(900))


def test_runs_reach_the_recall():
    """Pairs at the threshold that share no node, in drawn sketches and trees of three large and eight small levels."""
    rnd = random.Random(1)

    def meets(agree, levels):
        if not levels:
            return True
        draws = 2 if levels in (12, *range(1, 9)) or rnd.random() < 0.25 else 1
        return any(agree[rnd.randrange(128)] and meets(agree, levels - 1) for _ in range(draws))

    missed = 0
    for _ in range(6000):
        agree = [rnd.random() < 0.8 for _ in range(128)]
        missed += not any(meets(agree, 12) for _ in range(chosenpath.runs_for(0.8)))
    assert missed <= 9 and chosenpath.runs_for(0.8) < 12


def test_ids_that_name_many_texts(spark):
    """Null and repeated ids bring no other texts: counts stay those of the rows."""
    rows = [(None, f"text {i} of many words that are all the same but {i}") for i in range(30)] + [(3, f"again {i} a text of many words and more {i} {i}") for i in range(30)]
    got = chosenpath.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 60 and sorted(r.n_links for r in got) == sorted(x[1] for x in brute([(k, t) for k, (_, t) in enumerate(rows)]))


def test_repeated_rows_and_null_ids(spark):
    t = " ".join(f"w{i}" for i in range(30))
    d = spark.createDataFrame([(None, t), (5, t), (5, t), (5, "other text " * 9), (None, None), (7, t + " end")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_links, r.component_id) for r in chosenpath.near_duplicates(d).collect()), key=str)
    assert got == sorted([(None, 3, 5), (5, 3, 5), (5, 3, 5), (5, 0, 5), (None, 0, None), (7, 3, 5)], key=str)
    assert chosenpath.near_duplicates(d.limit(0)).count() == 0


def test_components(spark):
    rnd = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(rnd.randint(0, 60), rnd.randint(0, 60)) for _ in range(30)] + [(500, i) for i in range(501, 540)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    label = {x: x for e in edges for x in e}
    for _ in range(100):
        for u, v in edges:
            label[u] = label[v] = min(label[u], label[v])
    linked = {x for u, v in edges if u != v for x in (u, v)}
    assert got == {x: y for x, y in label.items() if x in linked}


def test_query_on_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = sorted((r.doc_id, r.n_links, r.component_id) for r in chosenpath.op6_ngram_join(spark, sf).collect())
    assert got == brute(rows)
