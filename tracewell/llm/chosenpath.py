"""Similarity join on word n-gram sets: the chosen-path method, then exact verification.

Sets are embedded by MinHash into ``COORDINATES`` (coordinate, value) tokens. In each of several
repeated runs a random tree splits the sets: every node draws coordinates, and a set goes to one
child per drawn coordinate, keyed by its value there; unlike sets soon part. Nodes of at most
``PART`` sets are solved inside a task, where they split again, as deep as it takes, until at most
``NODE`` sets are compared by brute force. Larger nodes are split by the cluster. The runs are repeated
until pairs at the threshold, with sketches as bad as ``SLACK`` allows, are missed with probability
below 1 - ``RECALL`` (see ``missed``).

Candidates are kept as a forest, not as pairs. In a large node ``PIVOTS`` members are compared with
all others: who agrees with a pivot gets one edge to it and its label. Members of one label are
connected already, so pairs of them add nothing: nodes of a single label end; a node with few members
outside its largest label compares these with all others; only what is mixed splits. So a group of
any number of near copies costs an edge a member, not one a pair, and no task sees more than
``PART`` members with the pivots or the ``STRAY`` others.

The components of the candidate forest (clusters) are then verified exactly: the hashed shingle sets
of a cluster are compared pair by pair in blocks, inside tasks, which count the links and
return a forest of the true ones.

Texts with equal word sequences are one class. Null, empty and word-free texts have no set and
link with nothing, not even each other. A text of fewer than n words, but not none, is one shingle.
Repeated rows are copies of one another; null ids take part but never name a class if a member
has an id; ties go to the smaller id; extra columns are ignored; an empty table gives an empty
result. Very long texts are hashed whole, a text at a time; blocks hold fewer of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.llm.bytesops import mix, shingle_hashes, slices, text_buffers, word_bounds, word_hashes
from tracewell.llm.components import components
from tracewell.llm.shared import only, salted_join, written

SHINGLE = 5
THRESHOLD = 0.8
COORDINATES = 128
#: Least share of the pairs at the threshold that the runs must bring together, through so many levels of large nodes.
RECALL, LEVELS = 0.9995, 3
NODE = 256
#: Members of a node that one task solves, pivots of a larger one, and members outside its largest label that meet all others.
PART = 4096
PIVOTS = 64
STRAY = 1024
#: Sketches of a pair at the threshold agree on fewer coordinates than this in 3 of 10,000 cases.
SLACK = 0.12
#: Classes, and shingles, of a block of the exact comparison.
CHUNK = 1024
CHUNK_SHINGLES = 1 << 21
BROADCAST_ROWS = 200_000
TEXT_HASH = "xxhash64(text, 11)"

_rng = np.random.Generator(np.random.PCG64(61))
_MULTIPLY = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64) | np.uint64(1)
_ADD = _rng.integers(1, 1 << 63, COORDINATES, dtype=np.uint64)


#: Coordinates that a root and a node inside a task draw; a large node draws one, or two in a quarter of the cases.
DRAWS = 2


def missed(agreement: float, levels: int = LEVELS) -> float:
    """Probability that a run parts a pair whose sketches agree in this share, through ``levels`` of large nodes."""
    inside = 0.0  # inside a task
    for _ in range(64):
        inside = (1 - agreement + agreement * inside) ** DRAWS
    q = inside
    for _ in range(levels):
        part = 1 - agreement + agreement * q
        q = 0.75 * part + 0.25 * part**2
    return (1 - agreement + agreement * q) ** DRAWS


def runs_for(threshold: float, recall: float = RECALL) -> int:
    """Runs that miss a pair at the threshold with probability below 1 - recall, over all sketches it may have."""
    p = np.arange(COORDINATES + 1)
    log = np.cumsum(np.log(np.maximum(p, 1)))
    chance = np.exp(log[-1] - log - log[::-1] + p * np.log(threshold) + p[::-1] * np.log(1 - threshold))
    q = np.array([missed(k / COORDINATES) for k in p])
    q[p < np.ceil((threshold - SLACK) * COORDINATES)] = 0  # the sketches' fault, not the trees'
    return next(r for r in range(1, COORDINATES) if (chance * q**r).sum() < 1 - recall)


def drawn(node: int, n: int) -> np.ndarray:
    """n coordinates of a node."""
    h = mix(np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ mix(np.array([node & (1 << 64) - 1], np.uint64)))
    return np.argsort(h)[:n]


def sampled(node: int) -> np.ndarray:
    """The coordinates that a large node splits on."""
    return drawn(node, 2 if mix(np.array([node & (1 << 64) - 1], np.uint64))[0] % np.uint64(4) == 0 else 1)


def root_tokens(threshold: float, recall: float = RECALL) -> np.ndarray:
    """The coordinates of all children of the roots: no two runs share one, so their nodes differ."""
    return np.sort(drawn(0x5851F42D4C957F2D, min(COORDINATES, runs_for(threshold, recall) * DRAWS)))


def sets_of(col: pa.Array, n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices [i, j) of rows: shingle hashes, their rows, and a key of each row's word sequence."""
    data, offsets = text_buffers(col)
    for i, j in slices(offsets):
        part = data[offsets[i] : offsets[j]]
        start, stop, row = word_bounds(part, offsets[i : j + 1] - offsets[i])
        words = word_hashes(part, start, stop)
        h, r = shingle_hashes(words, row, n)
        count = np.bincount(row, minlength=j - i)
        first = np.cumsum(count) - count
        place = (np.arange(len(words)) - first[row]).astype(np.uint64)
        keys = count.astype(np.uint64)
        np.add.at(keys, row, mix(words ^ mix(place * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))))
        keys = mix(keys).view(np.int64)
        yield i, j, h, r, keys


def sketches(docs: DataFrame, n: int, tokens: np.ndarray) -> DataFrame:
    """doc_id, text hash, class key, number of shingles, sketch and first-level nodes of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, r, keys in sets_of(batch.column("text"), n):
                m = j - i
                size = np.bincount(r, minlength=m)
                filled = np.flatnonzero(size)
                starts = (np.cumsum(size) - size)[filled]
                least = np.zeros((len(filled), COORDINATES), np.uint64)
                if len(filled):
                    for c in range(COORDINATES):
                        v = h * _MULTIPLY[c] + _ADD[c]
                        v ^= v >> np.uint64(32)
                        least[:, c] = np.minimum.reduceat(v, starts)
                sketch: list = [None] * m
                nodes: list = [[]] * m
                low = (mix(least) >> np.uint64(48)).astype(np.uint16)
                child = mix(least[:, tokens] + mix(tokens.astype(np.uint64) + np.uint64(1))).view(np.int64)
                for k, row in enumerate(filled.tolist()):
                    sketch[row] = low[k].tobytes()
                    nodes[row] = child[k]
                names = ["doc_id", "text_hash", "cls", "n_shingles", "sketch", "nodes"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, m), batch.column("text_hash").slice(i, m), pa.array(keys), pa.array(size.astype(np.int64)), pa.array(sketch, pa.binary()), pa.array(nodes, pa.list_(pa.int64()))], names=names
                )

    schema = "doc_id long, text_hash long, cls long, n_shingles long, sketch binary, nodes array<long>"
    return docs.select("doc_id", "text", F.expr(TEXT_HASH).alias("text_hash")).mapInArrow(run, schema)


def complete_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Sorted batches, cut so that no group is split between tables."""
    rest: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key)
        last = np.flatnonzero(np.diff(k.to_numpy(zero_copy_only=False)))
        if not len(last):
            if rest and rest[-1].column(key)[-1] != k[0]:
                yield pa.Table.from_batches(rest)
                rest = []
            rest.append(batch)
            continue
        cut = int(last[-1]) + 1
        yield pa.Table.from_batches([*rest, batch.slice(0, cut)])
        rest = [batch.slice(cut)]
    if rest:
        yield pa.Table.from_batches(rest)


def groups(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    cuts = np.flatnonzero(np.diff(keys)) + 1
    starts = np.concatenate([[0], cuts])
    for a, b in zip(starts.tolist(), [*cuts.tolist(), len(keys)], strict=True):
        yield a, b


def sketch_rows(col: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), np.uint16).reshape(-1, COORDINATES)


class Node:
    """The members of a node that fits a task: finds edges that join all which agree, if a path brings them together."""

    def __init__(self, s: np.ndarray, label: np.ndarray, least: int, key: int):
        self.s, self.least, self.key = s, least, key
        _, self.label = np.unique(label, return_inverse=True)
        self.edges: list[tuple[int, int]] = []

    def meet(self, a: int, others: np.ndarray) -> None:
        """One edge to each label that ``a`` agrees with."""
        others = others[self.label[others] != self.label[a]]
        hit = others[(self.s[others] == self.s[a]).sum(1) >= self.least]
        if len(hit):
            labels, first = np.unique(self.label[hit], return_index=True)
            self.edges += [(a, int(x)) for x in hit[first]]
            self.label[np.isin(self.label, labels)] = self.label[a]

    def solve(self) -> list[tuple[int, int]]:
        todo = [(np.arange(len(self.s)), 0)]
        turn = 0
        while todo:
            at, depth = todo.pop()
            turn += 1
            if len(at) > NODE and depth < 64:
                for a in at[:: max(1, len(at) // 8)].tolist():
                    self.meet(a, at)
            labels, n = np.unique(self.label[at], return_counts=True)
            if len(labels) == 1:
                continue
            stray = at[self.label[at] != labels[n.argmax()]]
            if len(at) <= NODE or depth >= 64 or len(stray) <= len(at) // 16:
                for a in stray.tolist():
                    self.meet(a, at)
                continue
            for c in drawn(self.key + turn, DRAWS):
                value = self.s[at, c]
                order = np.argsort(value, kind="stable")
                todo += [(at[order[x:y]], depth + 1) for x, y in groups(value[order]) if y - x > 1]
        return self.edges


EDGES = ["u", "v"]


def node_edges(members: DataFrame, threshold: float) -> DataFrame:
    """A forest (u, v) of the members of each node that fits a task."""
    least = int(np.ceil((threshold - SLACK) * COORDINATES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in complete_groups(batches, "node"):
            keys, ids, label, flat = (rows.column("node").to_numpy(), rows.column("cls").to_numpy(), rows.column("label").to_numpy(), sketch_rows(rows.column("sketch")))
            us: list[int] = []
            vs: list[int] = []
            for a, b in groups(keys):
                for x, y in Node(flat[a:b], label[a:b], least, int(keys[a])).solve():
                    us.append(int(ids[a + x]))
                    vs.append(int(ids[a + y]))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=EDGES)

    spread = members.select("node", "cls", "label", "sketch").repartition("node").sortWithinPartitions("node", "cls")
    return spread.mapInArrow(run, "u long, v long").distinct()


STAR = "u long, v long, node long, cls long, label long, sketch binary"
_STAR = ["u", "v", "node", "cls", "label", "sketch"]


def edge_batch(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    none = pa.nulls(len(u), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), none, none, none, pa.nulls(len(u), pa.binary())], names=_STAR)


def met(members: DataFrame, guests: DataFrame, threshold: float, relabel: bool) -> DataFrame:
    """Edges (u, v) of the guests of every large node with its members; with ``relabel`` the members again, with their labels.

    Members are dealt to parts of at most ``PART`` on average, and the guests go to each of them.
    """
    least = int(np.ceil((threshold - SLACK) * COORDINATES))
    n_parts = F.ceil(F.col("size") / PART).cast("long")
    part = lambda p: F.xxhash64("node", p).alias("part")
    columns = ["node", "cls", "label", "sketch"]
    each = guests.select("size", *columns, F.explode(F.sequence(F.lit(0).cast("long"), n_parts - 1)).alias("p")).select(part("p"), F.lit(0).alias("member"), *columns)
    rows = members.select(part(F.pmod(F.xxhash64("cls", F.lit(3)), n_parts)), F.lit(1).alias("member"), *columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in complete_groups(batches, "part"):
            kind, ids, labels, flat = (table.column("member").to_numpy(), table.column("cls").to_numpy(), table.column("label").to_numpy(), sketch_rows(table.column("sketch")))
            for a, b in groups(table.column("part").to_numpy()):
                first = a + int((kind[a:b] == 0).sum())
                # guests that agree with each other have one label, the same in all parts of the node
                own = Node(flat[a:first], labels[a:first], least, 0)
                for k in range(first - a):
                    own.meet(k, np.arange(first - a))
                leader = labels[a:first].copy()
                for x in np.unique(own.label):
                    leader[own.label == x] = leader[own.label == x].min()
                old = labels[first:b]
                new = old.copy()
                free = np.ones(b - first, bool)
                us, vs = [leader], [labels[a:first]]
                for k in range(first - a):
                    agree = (flat[first:b] == flat[a + k]).sum(1) >= least
                    other = np.unique(old[agree])
                    us.append(np.full(len(other), leader[k]))
                    vs.append(other)
                    new[agree & free] = leader[k]
                    free &= ~agree
                u, v = np.concatenate(us), np.concatenate(vs)
                yield edge_batch(u[u != v], v[u != v])
                if relabel and b > first:
                    none = pa.nulls(b - first, pa.int64())
                    node, sketch = (table.column(c).slice(first, b - first).combine_chunks() for c in ("node", "sketch"))
                    yield pa.RecordBatch.from_arrays([none, none, node, pa.array(ids[first:b]), pa.array(new), sketch], names=_STAR)

    spread = rows.unionByName(each).repartition("part").sortWithinPartitions("part", "member", "cls")
    return spread.mapInArrow(run, STAR)


def split_nodes(members: DataFrame) -> DataFrame:
    """The children of large nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, flat = batch.column("node").to_numpy(), sketch_rows(batch.column("sketch"))
            for k in np.unique(keys):
                at = np.flatnonzero(keys == k)
                take = pa.array(at)
                base = mix(np.array([k], np.int64).view(np.uint64))
                for c in sampled(int(k)):
                    child = mix(flat[at, c].astype(np.uint64) + base + np.uint64((int(c) + 1) << 16)).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(child), *(batch.column(x).take(take) for x in ("cls", "label", "sketch"))], names=["node", "cls", "label", "sketch"])

    return members.select("node", "cls", "label", "sketch").mapInArrow(run, "node long, cls long, label long, sketch binary")


def candidates(classes: DataFrame, threshold: float) -> DataFrame:
    """Candidate forest (u, v) over the classes from all runs of the tree."""
    rows = classes.select(F.explode("nodes").alias("node"), "cls")
    busy = rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
    members = salted_join(rows, busy, ["node"], "size").join(classes.select("cls", "sketch"), "cls").withColumn("label", F.col("cls"))
    members = written(members.select("node", "size", "cls", "label", "sketch"), "nodes")
    found = None
    while True:
        edges = node_edges(members.filter(F.col("size") <= PART), threshold)
        found = edges if found is None else found.unionByName(edges)
        large = members.filter(F.col("size") > PART)
        if large.isEmpty():
            return found
        place = F.row_number().over(Window.partitionBy("node").orderBy(F.xxhash64("cls", F.lit(5)), "cls"))
        pivots = large.withColumn("k", place).filter(F.col("k") <= PIVOTS).drop("k")
        star = written(met(large, pivots, threshold, True), "star")
        edge = lambda df: df.filter("u is not null").select("u", "v").distinct()
        found = found.unionByName(edge(star))
        left = star.filter("u is null").select("node", "cls", "label", "sketch")
        per_label = left.groupBy("node", "label").agg(F.count("*").alias("n"))
        nodes = per_label.groupBy("node").agg(F.sum("n").alias("size"), F.max(F.struct("n", "label")).alias("top"))
        nodes = nodes.select("node", "size", F.col("top.label").alias("top"), (F.col("size") - F.col("top.n")).alias("stray")).filter("stray > 0")
        left = written(salted_join(left, nodes, ["node"], "size"), "left")
        few = left.filter(F.col("stray") <= STRAY)
        found = found.unionByName(edge(met(few, few.filter("label != top"), threshold, False)))
        children = written(split_nodes(left.filter(F.col("stray") > STRAY)), "children")
        busy = children.groupBy("node").agg(F.count("*").alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo != hi")
        members = salted_join(children, busy.select("node", "size"), ["node"], "size")
        members = written(members.select("node", "size", "cls", "label", "sketch"), "nodes")


def exact_links(sets: DataFrame, threshold: float) -> DataFrame:
    """Per block: link weight of each class, and a forest (other) of the classes that link.

    A cluster is cut into chunks by a hash; a block compares two chunks, or one with itself.
    """
    g = F.greatest(F.ceil(F.col("size") / (CHUNK / 2)), F.ceil(F.col("shingles") / (CHUNK_SHINGLES / 2)), F.lit(1)).cast("int")
    g = F.when((F.col("size") <= CHUNK) & (F.col("shingles") <= CHUNK_SHINGLES), 1).otherwise(g)
    chunked = sets.withColumn("g", g).withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(3)), F.col("g")).cast("int"))
    rows = chunked.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    lo, hi = F.least("chunk", "o"), F.greatest("chunk", "o")
    rows = rows.select(F.xxhash64("cluster", lo, hi).alias("part"), (lo == hi).alias("same"), "chunk", "cls", "copies", "hashes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in complete_groups(batches, "part"):
            for a, b in groups(rows.column("part").to_numpy()):
                yield _compare(rows.slice(a, b - a), threshold)

    spread = rows.repartition("part").sortWithinPartitions("part")
    return spread.mapInArrow(run, "cls long, links long, other long")


def _compare(rows: pa.Table, threshold: float) -> pa.RecordBatch:
    m = rows.num_rows
    ids, copies, chunk = rows.column("cls").to_numpy(), rows.column("copies").to_numpy(), rows.column("chunk").to_numpy()
    raw = rows.column("hashes").to_pylist()
    size = np.array([len(x) // 8 for x in raw], np.int64)
    h, r = np.frombuffer(b"".join(raw), np.uint64), np.repeat(np.arange(m), size)
    _, column, count = np.unique(h, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    names = np.flatnonzero(count > 1)
    column, r = np.searchsorted(names, column[shared]), r[shared]
    order = np.argsort(column, kind="stable")
    column, r = column[order], r[order]
    both = np.zeros((m, m), np.float32)
    step = max(1, (4 << 20) // max(1, m))  # columns at a time: at most 16 MB
    for c in range(0, len(names), step):
        i, j = np.searchsorted(column, (c, c + step))
        x = np.zeros((m, min(step, len(names) - c)), np.float32)
        x[r[i:j], column[i:j] - c] = 1
        both += x @ x.T
    linked = both >= threshold * (size[:, None] + size[None, :] - both.astype(np.float64)) - 1e-9
    linked &= both > 0
    np.fill_diagonal(linked, False)
    if not rows.column("same")[0].as_py():
        linked &= chunk[:, None] != chunk[None, :]  # pairs inside a chunk are compared elsewhere
    root = np.arange(m)
    reached = np.zeros(m, bool)
    for first in range(m):
        if reached[first]:
            continue
        reached[first] = True
        todo = [first]
        while todo:
            new = np.flatnonzero(linked[todo.pop()] & ~reached)
            reached[new] = True
            root[new] = first
            todo += new.tolist()
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(linked @ copies), pa.array(ids[root])], names=["cls", "links", "other"])


def near_duplicates(docs: DataFrame, n: int = SHINGLE, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """doc_id, text_hash, class_id (smallest id of the texts with the same words), n_links, component_id, kept.

    n_links counts all other rows whose set has Jaccard similarity >= threshold, copies
    included. component_id is the smallest id reachable by links; kept marks one row of each
    component (of rows with equal id and text all are marked), and every row without words.
    """
    return only(docs.sparkSession, lambda: _near_duplicates(docs, n, threshold, recall), "near_duplicates")


def _near_duplicates(docs: DataFrame, n: int, threshold: float, recall: float) -> DataFrame:
    spark = docs.sparkSession
    rows = written(sketches(docs, n, root_tokens(threshold, recall)), "sketches")
    filled = rows.filter("n_shingles > 0")
    named = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    classes = filled.groupBy("cls").agg(F.min(named).alias("rep"), F.count("*").alias("copies"), F.min(F.struct("n_shingles", "sketch", "nodes")).alias("x"))
    classes = classes.select("cls", F.col("rep.doc_id").alias("class_id"), F.col("rep.text_hash").alias("text_hash"), "copies", "x.n_shingles", "x.sketch", "x.nodes")
    classes = written(classes, "classes")
    clusters = components(only(spark, lambda: candidates(classes, threshold), "candidates"))
    clusters = clusters.select(F.col("id").alias("cls"), F.col("component").alias("cluster"))
    picked = written(classes.join(clusters, "cls").select("class_id", "text_hash", "cls", "copies", "cluster", "n_shingles"), "picked")
    sizes = picked.groupBy("cluster").agg(F.count("*").alias("size"), F.sum("n_shingles").alias("shingles"))
    links = only(spark, lambda: exact_links(written(shingle_sets(docs, picked, n), "cluster_sets").join(sizes, "cluster"), threshold), "links")
    counted = links.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = components(links.filter("cls != other").select(F.col("cls").alias("u"), F.col("other").alias("v")))
    named = classes.select("cls", "class_id", "text_hash", "copies").join(counted, "cls", "left").join(joined.withColumnRenamed("id", "cls"), "cls", "left")
    named = named.withColumn("component", F.coalesce("component", "cls"))
    heads = named.groupBy("component").agg(F.min(F.struct(F.col("class_id").isNull().alias("last"), "class_id", "text_hash")).alias("head"))
    named = named.join(heads, "component").select("cls", "copies", "class_id", "head", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = salted_join(filled.select("doc_id", "text_hash", "cls"), written(named, "named"), ["cls"], "copies")
    kept = F.col("doc_id").eqNullSafe(F.col("head.class_id")) & (F.col("text_hash") == F.col("head.text_hash"))
    out = out.select("doc_id", "text_hash", "class_id", "n_links", F.col("head.class_id").alias("component_id"), kept.alias("kept"))
    own = F.col("doc_id")
    alone = rows.filter("n_shingles = 0").select("doc_id", "text_hash", own.alias("class_id"), F.lit(0).cast("long").alias("n_links"), own.alias("component_id"), F.lit(True).alias("kept"))
    return out.unionByName(alone)


def shingle_sets(docs: DataFrame, picked: DataFrame, n: int) -> DataFrame:
    """cls, cluster, copies and the hashed shingles of one text of every picked class.

    Texts are found by their id and hash, so ids that name many texts bring no others.
    """
    keys = picked.select("class_id", "text_hash", "cls", "copies", "cluster")
    keys = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    rows = docs.select("doc_id", "text", F.expr(TEXT_HASH).alias("text_hash")).filter("text != ''")
    found = rows.join(keys, rows["doc_id"].eqNullSafe(keys["class_id"]) & (rows["text_hash"] == keys["text_hash"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, h, r, _ in sets_of(batch.column("text"), n):
                cuts = np.searchsorted(r, np.arange(j - i + 1))
                sets = [np.unique(h[a:b]).tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
                part = batch.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("cls", "cluster", "copies")), pa.array(sets, pa.binary())], names=["cls", "cluster", "copies", "hashes"])

    sets = found.select("cls", "cluster", "copies", "text").mapInArrow(run, "cls long, cluster long, copies long, hashes binary")
    return sets.dropDuplicates(["cls"])


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, five-word shingles, Jaccard similarity of 0.8 or more."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("text_hash")
