"""Line dedup against comparison of all pairs of lines."""

import random

from tracewell.llm import lines


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if a == b:
        return True
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def brute(rows, text_hash, least):
    every = []
    for i, t in set(rows):
        for k, s in enumerate((t or "").split("\n") if t is not None else []):
            s = s.strip(" ")
            if len(s) >= least:
                every.append(((i is None, i or 0, text_hash[t]), k, s))
    every.sort(key=lambda x: x[:2])
    gone = set()
    for n, (d, k, s) in enumerate(every):
        if any(one_edit(s, e) for _, _, e in every[:n]):
            gone.add((d, k))
    out = []
    for i, t in rows:
        d = (i is None, i or 0, text_hash.get(t))
        out.append((i, None if t is None else "\n".join(s for k, s in enumerate(t.split("\n")) if (d, k) not in gone)))
    return sorted(out, key=str)


def check(spark, rows):
    d = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "doc_id long, text string, line int, n_lines string")
    hashes = {r.text: r.h for r in d.selectExpr("text", f"{lines.TEXT_HASH} h").collect()}
    got = lines.dedup_lines(d, 5)
    assert got.columns == ["doc_id", "text", "line", "n_lines", "n_removed_lines"]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute(rows, hashes, 5)


def test_random_lines(spark, monkeypatch):
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abü ") for _ in range(rnd.randint(3, 14))) for _ in range(25)]

    def changed(s):
        for _ in range(rnd.choice([0, 0, 1, 1, 2])):
            i = rnd.randint(0, len(s))
            s = rnd.choice([s[:i] + "x" + s[i:], s[:i] + s[i + 1 :], s[:i] + "ß" + s[i + 1 :]])
        return s

    rows = [(rnd.choice([*range(30), None]), "\n".join(changed(rnd.choice(base)) for _ in range(rnd.randint(0, 6)))) for _ in range(50)]
    rows += [(1, None), (None, None), (7, ""), (8, "\n\n"), (9, rows[0][1]), rows[0], rows[0], (10, "  " + base[0] + " \n" + "long " * 4000)]
    check(spark, rows)
    monkeypatch.setattr(lines, "BROADCAST_ROWS", 0)
    check(spark, rows[:20])


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_short_lines(spark):
    rows = [(1, "Les.\n\n \nLes.\n1234567890abcde"), (2, " Les. \nLas.\n\n\t\n1234567890abcdf\n1234567890abcdef"), (3, "Les.\n\t\n1234567890abcdeg")]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "Les.\n\n \n1234567890abcde", 2: "Las.\n\n\t\n1234567890abcdf\n1234567890abcdef", 3: "\t"}


def test_edit_bounds(spark):
    rnd = random.Random(9)
    base = ["".join(rnd.choice("abcü") for _ in range(rnd.randint(6, 11))) for _ in range(12)]

    def changed(s):
        for _ in range(rnd.randint(0, 4)):
            i = rnd.randint(0, len(s))
            s = rnd.choice([s[:i] + "x" + s[i:], s[:i] + s[i + 1 :], s[:i] + "ß" + s[i + 1 :]])
        return s

    rows = [(i, changed(rnd.choice(base))) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for edits in (2, 3):
        want = {i for i, s in rows if len(s) >= 5 and any(len(e) >= 5 and distance(s, e) <= edits for _, e in rows[:i])}
        assert {r.doc_id for r in lines.dedup_lines(d, 5, edits).collect() if r.n_removed_lines} == want


def test_empty_table(spark):
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_query(spark):
    got = lines.op8_line_dedup(spark, "/root/testdata/sf0.001")
    assert got.count() == 200 and got.filter("n_removed > 0").count() > 0
