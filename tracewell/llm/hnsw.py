"""Embedding near-dedup: navigable small-world graphs per shard, exact verification, union.

Vectors of equal components are one class. Classes are dealt to shards by hash; every shard
builds a hierarchical graph (levels drawn geometrically, neighbours chosen so that they
are nearer to the new vector than to each other). Every class then queries every shard in
blocks, which pass by a graph one after the other. A beam is widened, query by query, while it is full of links, and for a whole block
while an audit of ``AUDIT`` of its queries against brute force in the shard finds less than
``RECALL`` of their true links, of all together and of one query on average; an audit that sees fewer
than ``EVIDENCE`` links takes more queries, up to four times as many. What the beams return is verified by cosine in double precision. Tasks
return counts and a forest of links, never the pairs of a group; the forests of all tasks are
united by ``components``.

Shards hold about ``SHARD`` vectors, however many there are in all, so memory is bounded; there are
at least ``SHARDS``. A graph is sent to one task, or, while there are few shards, to so many that
there are about ``RUNS``; the blocks of queries are dealt to these runs.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing, as do vectors of unequal lengths; repeated rows are copies of each other;
a null id takes part but never names a component that has an id; labels and extra columns are ignored.
Components keep the precision they have, float or double, and cosines are taken in double.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.bytesops import mix
from tracewell.llm.components import components
from tracewell.llm.shared import only, salted_join, written

COSINE = 0.95
SHARD = 16_384
SHARDS = 4
QUERIES = 4096
RUNS = 64
#: The part of a graph's row, before those of its queries.
GRAPH = -1
M = 12
WIDTH = 24
EF = 48
#: Beam of the upper layers: groups that turn inward at the lowest layer are entered from above.
ENTRY = 24
#: Edges into a group that the others have no path to.
POCKET = 16
AUDIT = 512
EVIDENCE = 32
RECALL = 0.99
#: A beam of width w opens max(4, w / AT_ONCE) nodes a step, so wide beams take few steps.
AT_ONCE = 24
#: Single-precision cosines this much below the limit are verified in double precision.
MARGIN = 1e-4


class Graph:
    """A hierarchical navigable small-world graph over unit vectors, built and searched in batches."""

    def __init__(self, x: np.ndarray, seed: int = 5):
        self.x = np.ascontiguousarray(x, np.float32)
        n = len(x)
        level = np.floor(-np.log(np.random.Generator(np.random.PCG64(seed)).random(n)) / np.log(M)).astype(int)
        self.order = np.argsort(-level, kind="stable")
        self.x = self.x[self.order]
        level = level[self.order]
        #: nodes of layer k are the first sizes[k]
        self.sizes = [int((level >= k).sum()) for k in range(int(level.max()) + 1)] if n else []
        self.layers: list[np.ndarray] = [np.zeros((0, WIDTH), np.int32)] * len(self.sizes)
        for k in reversed(range(len(self.sizes))):
            self._build(k)

    def _build(self, k: int) -> None:
        n = self.sizes[k]
        adj = self.layers[k] = np.full((n, WIDTH), -1, np.int32)
        done = 0
        while done < n:
            new = np.arange(done, min(n, done + max(32, min(512, done))))
            q = self.x[new]
            near = q @ q.T
            np.fill_diagonal(near, -np.inf)
            take = min(WIDTH, len(new) - 1)
            own = np.argpartition(-near, take - 1, 1)[:, :take] if take > 0 else np.zeros((len(new), 0), int)
            ids, sim = new[own].astype(np.int32), np.take_along_axis(near, own, 1)
            if done:
                start = self.descend(q, k)
                start[start >= done] = 0
                found, s = self.beam(q, start, EF, k)
                ids, sim = np.concatenate([found, ids], 1), np.concatenate([s, sim], 1)
            adj[new, :M] = self.chosen(q, ids, sim, M)
            self._link_back(adj, new)
            done += len(new)
        if n:
            self._open_pockets(k)

    def _open_pockets(self, k: int) -> None:
        """Groups that no path from the layer's first node enters get edges from the nearest nodes that have one."""
        x, extra = self.x[: self.sizes[k]], []
        reached = np.zeros(self.sizes[k], bool)
        front = np.zeros(1, np.int64)
        while True:
            while len(front):
                reached[front] = True
                front = np.unique(self.layers[k][front])
                front = front[(front >= 0) & ~reached[front]]
            if reached.all():
                break
            inside = np.flatnonzero(reached)
            head = int(np.argmin(reached))
            near = inside[np.argsort(-(x[inside] @ x[head]), kind="stable")[:POCKET]]
            extra.append((near, head))
            front = np.array([head])
        if extra:
            src, dst = np.concatenate([a for a, _ in extra]), np.repeat([b for _, b in extra], [len(a) for a, _ in extra])
            order = np.argsort(src, kind="stable")
            src, dst = src[order], dst[order]
            place = np.arange(len(src)) - np.searchsorted(src, src)
            more = np.full((self.sizes[k], int(place.max()) + 1), -1, np.int32)
            more[src, place] = dst
            self.layers[k] = np.concatenate([self.layers[k], more], 1)

    def _link_back(self, adj: np.ndarray, new: np.ndarray) -> None:
        """Edges from the neighbours of new nodes to them; lists that overflow are chosen anew."""
        to = adj[new, :M]
        src, dst = np.repeat(new, M)[to.ravel() >= 0], to.ravel()[to.ravel() >= 0]
        order = np.argsort(dst, kind="stable")
        src, dst = src[order], dst[order]
        heads = np.flatnonzero(np.diff(dst, prepend=-1))
        most = int(np.diff(np.append(heads, len(dst))).max()) if len(dst) else 0
        if not most:
            return
        nodes = dst[heads]
        extra = np.full((len(nodes), most), -1, np.int32)
        at = np.repeat(np.arange(len(nodes)), np.diff(np.append(heads, len(dst))))
        extra[at, np.arange(len(dst)) - heads[at]] = src
        for i in range(0, len(nodes), 256):
            own = nodes[i : i + 256]
            ids = np.concatenate([adj[own], extra[i : i + 256]], 1)
            sim = np.einsum("bd,bcd->bc", self.x[own], self.x[ids])
            sim[ids < 0] = -np.inf
            adj[own] = self.chosen(self.x[own], ids, sim, WIDTH)

    def chosen(self, q: np.ndarray, ids: np.ndarray, sim: np.ndarray, m: int) -> np.ndarray:
        """At most m of the candidates, the nearest first that is nearer to q than to one taken before; then the nearest others."""
        c = min(ids.shape[1], max(2 * m, EF))
        order = np.argsort(-sim, 1, kind="stable")[:, :c]
        ids, sim = np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)
        ok = np.isfinite(sim)
        again = np.zeros_like(ok)
        for j in range(1, c):  # a node may be named twice
            again[:, j] = (ids[:, :j] == ids[:, j : j + 1]).any(1)
        ok &= ~again
        v = self.x[ids]
        pair = np.einsum("bcd,bed->bce", v, v)
        taken = np.zeros_like(ok)
        for j in range(c):
            closer = (taken & (pair[:, j] > sim[:, j : j + 1])).any(1)
            taken[:, j] = ok[:, j] & ~closer & (taken.sum(1) < m)
        rank = np.where(taken, 0, np.where(ok, 1, 2)) * c + np.arange(c)
        first = np.argsort(rank, 1)[:, :m]
        out = np.where(np.take_along_axis(ok, first, 1), np.take_along_axis(ids, first, 1), -1).astype(np.int32)
        return np.pad(out, ((0, 0), (0, m - out.shape[1])), constant_values=-1)

    def descend(self, q: np.ndarray, layer: int) -> np.ndarray:
        """The entry of each query at a layer: the nearest that the layers above lead to."""
        at = np.zeros(len(q), np.int64)
        for k in reversed(range(layer + 1, len(self.sizes))):
            at = self.beam(q, at, min(ENTRY, self.sizes[k]), k)[0][:, 0].astype(np.int64)
        return at

    def beam(self, q: np.ndarray, start: np.ndarray, ef: int, layer: int) -> tuple[np.ndarray, np.ndarray]:
        """Best first search of all queries in lockstep: ids and cosines, best first; -1 and -inf fill up."""
        adj, b = self.layers[layer], len(q)
        ids = np.full((b, ef), -1, np.int32)
        sim = np.full((b, ef), -np.inf, np.float32)
        fresh = np.zeros((b, ef), bool)
        seen = np.zeros((b, self.sizes[layer]), bool)
        ids[:, 0] = start
        sim[:, 0] = np.einsum("bd,bd->b", q, self.x[start])
        fresh[:, 0] = True
        seen[np.arange(b), start] = True
        live = np.arange(b)
        at_once = min(max(4, ef // AT_ONCE), ef)
        while len(live):
            open_sim = np.where(fresh[live], sim[live], -np.inf)
            pick = np.argpartition(-open_sim, at_once - 1, 1)[:, :at_once] if at_once < ef else np.argsort(-open_sim, 1)[:, :at_once]
            good = np.take_along_axis(open_sim, pick, 1) > -np.inf
            node = np.where(good, np.take_along_axis(ids[live], pick, 1), -1)
            fresh[live[:, None], pick] = False
            nxt = np.where((node >= 0)[:, :, None], adj[node], -1).reshape(len(live), -1)
            nxt.sort(1)
            ok = nxt >= 0
            ok[:, 1:] &= nxt[:, 1:] != nxt[:, :-1]
            ok &= ~seen[live[:, None], nxt]
            r, c = np.nonzero(ok)
            seen[live[r], nxt[r, c]] = True
            s = np.full(nxt.shape, -np.inf, np.float32)
            s[r, c] = np.einsum("id,id->i", q[live[r]], self.x[nxt[r, c]])
            every_sim = np.concatenate([sim[live], s], 1)
            keep = np.argpartition(-every_sim, ef - 1, 1)[:, :ef]
            sim[live] = np.take_along_axis(every_sim, keep, 1)
            ids[live] = np.take_along_axis(np.concatenate([ids[live], np.where(ok, nxt, -1)], 1), keep, 1)
            fresh[live] = np.take_along_axis(np.concatenate([fresh[live], ok], 1), keep, 1)
            live = live[(fresh[live] & (sim[live] > -np.inf)).any(1)]
        order = np.argsort(-sim, 1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sim, order, 1)

    def links(self, q: np.ndarray, least: float, ef: int) -> Iterator[tuple[int, np.ndarray]]:
        """(query, ids) of all neighbours the beams find with cosine >= least; full beams are widened."""
        for i in range(0, len(q), 512):
            todo = np.arange(i, min(i + 512, len(q)))
            start = self.descend(q[todo], 0)
            width = ef
            while len(todo):
                width = min(width, self.sizes[0])
                full = []
                step = max(8, (1 << 22) // max(1, width * 16))
                for j in range(0, len(todo), step):
                    ids, sim = self.beam(q[todo[j : j + step]], start[j : j + step], width, 0)
                    more = (sim[:, -1] >= least) & (width < self.sizes[0])
                    full.append(more)
                    for k in np.flatnonzero(~more & (sim[:, 0] >= least)):
                        yield int(todo[j + k]), ids[k][sim[k] >= least]
                more = np.concatenate(full)
                todo, start, width = todo[more], start[more], width * 4

    def audited_width(self, q: np.ndarray, least: float) -> int:
        """The beam at which a sample of the queries finds the target share of their true links."""
        pick, true = q[:0], np.zeros((0, len(self.x)), bool)
        for k in range(1, 5):
            pick = q[np.linspace(0, len(q) - 1, min(k * AUDIT, len(q))).astype(int)] if len(q) else q
            true = pick @ self.x.T >= least
            if true.sum() >= EVIDENCE + len(pick) or len(pick) == len(q):  # most vectors find themselves
                break
        asked = np.flatnonzero(true.any(1))
        pick, n = pick[asked], true[asked].sum(1)
        width = min(EF, self.sizes[0])
        while width < self.sizes[0] and len(asked):
            got = np.zeros(len(asked), np.int64)
            for a, found in self.links(pick, least, width):
                got[a] = len(np.unique(found))
            if got.sum() >= RECALL * n.sum() and (got / n).mean() >= RECALL:
                break
            width = min(width * 2, self.sizes[0])
        return width

    def dump(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, x=self.x, order=self.order, sizes=np.array(self.sizes), **{f"l{k}": a for k, a in enumerate(self.layers)})
        return out.getvalue()

    @classmethod
    def load(cls, raw: bytes) -> Graph:
        out, z = cls.__new__(cls), np.load(io.BytesIO(raw))
        out.x, out.order, out.sizes = z["x"], z["order"], z["sizes"].tolist()
        out.layers = [z[f"l{k}"] for k in range(len(out.sizes))]
        return out


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, in double precision, safe for very large and small components."""
    raw = raw.astype(np.float64)
    raw = raw / np.abs(raw).max(1, keepdims=True)
    return raw / np.sqrt((raw * raw).sum(1, keepdims=True))


def precision(df: DataFrame) -> type:
    """The component type of the vectors: float stays float, all others are doubles."""
    return np.float32 if dict(df.dtypes)["embedding"] == "array<float>" else np.float64


def vectors(df: DataFrame) -> DataFrame:
    """vec_id, dim (0: links with nothing), cls (hash of the components) and the components as bytes."""
    kind = precision(df)
    bits = np.uint32 if kind is np.float32 else np.uint64

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("embedding")
            dim = np.zeros(batch.num_rows, np.int32)
            cls = np.zeros(batch.num_rows, np.int64)
            raw: list = [None] * batch.num_rows
            lengths = np.asarray(col.value_lengths().fill_null(0))
            flat = np.asarray(col.flatten().to_numpy(zero_copy_only=False), kind)
            stop = np.cumsum(lengths)
            for i in np.flatnonzero(lengths):
                v = flat[stop[i] - lengths[i] : stop[i]] + kind(0)  # -0.0 becomes 0.0
                if np.isfinite(v).all() and v.any():
                    dim[i], raw[i] = len(v), v.tobytes()
                    place = mix(np.arange(len(v), dtype=np.uint64))
                    cls[i] = mix(np.bitwise_xor.reduce(mix(v.view(bits).astype(np.uint64) ^ place), keepdims=True)).view(np.int64)[0]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(dim), pa.array(cls), pa.array(raw, pa.binary())], names=["vec_id", "dim", "cls", "raw"])

    element = "float" if kind is np.float32 else "double"
    return df.select("vec_id", F.col("embedding").cast(f"array<{element}>").alias("embedding")).mapInArrow(run, "vec_id long, dim int, cls long, raw binary")


def matrix(rows: pa.Table, kind: type) -> np.ndarray:
    raw = rows.column("raw").to_pylist()
    return np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1)


def build(kind: type):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("cls")
        g = Graph(unit(matrix(rows, kind)))
        rows = rows.take(pa.array(g.order))
        body = [g.dump(), rows.column("cls").to_numpy().tobytes(), rows.column("copies").to_numpy().tobytes(), matrix(rows, kind).tobytes()]
        return pa.Table.from_arrays([rows.column("dim")[:1], rows.column("shard")[:1], *(pa.array([b], pa.binary()) for b in body)], names=["dim", "shard", "graph", "ids", "copies", "raws"])

    return run


FOUND = "cls long, links long, other long"


@dataclass
class Shard:
    """A shard's graph with the classes, copies and unit vectors of its nodes."""

    g: Graph
    ids: np.ndarray
    copies: np.ndarray
    base: np.ndarray

    @classmethod
    def load(cls, row: pa.RecordBatch, kind: type) -> Shard:
        ids, copies = np.frombuffer(row.column("ids")[0].as_py(), np.int64), np.frombuffer(row.column("copies")[0].as_py(), np.int64)
        return cls(Graph.load(row.column("graph")[0].as_py()), ids, copies, unit(np.frombuffer(row.column("raws")[0].as_py(), kind).reshape(len(ids), -1)))

    def found(self, queries: pa.Table, least: float, kind: type) -> pa.RecordBatch:
        ids, copies, base = self.ids, self.copies, self.base
        queries = queries.sort_by("cls")
        own = queries.column("cls").to_numpy()
        exact = unit(matrix(queries, kind))
        q = exact.astype(np.float32)
        links, other = np.zeros(len(own), np.int64), own.copy()
        label = np.arange(len(ids))  # joined vectors of the shard have one label, the place of one of them
        edges: list[tuple[int, int]] = []
        low = least - MARGIN
        for i, found in self.g.links(q, low, self.g.audited_width(q, low)):
            found = found[(base[found] @ exact[i] >= least) & (ids[found] != own[i])]
            if not len(found):
                continue
            links[i], other[i] = copies[found].sum(), ids[found[0]]
            labels = np.unique(label[found])
            if len(labels) > 1:
                edges += [(labels[0], x) for x in labels[1:].tolist()]
                label[np.isin(label, labels)] = labels[0]
        a, b = ids[[a for a, _ in edges]], ids[[b for _, b in edges]]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([own, a])), pa.array(np.concatenate([links, np.zeros(len(a), np.int64)])), pa.array(np.concatenate([other, b]))], names=["cls", "links", "other"])


def lent(runs: int):
    """Every graph once for each run, one at a time: a JVM explode holds all copies of a row in its heap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                for r in range(runs):
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.array([r], pa.int32()), pa.array([GRAPH], pa.int32())], names=[*row.schema.names, "run", "part"])

    return run


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], int, pa.Table]]:
    """Consecutive rows of one (dim, shard, run) and part."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        keys = np.stack([batch.column(n).to_numpy() for n in ("dim", "shard", "run", "part")], 1)
        cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
            if i == j:
                continue
            key = tuple(keys[i].tolist())
            if held and key != last:
                yield last[:3], last[3], pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(i, j - i))
    if held:
        yield last[:3], last[3], pa.Table.from_batches(held)


def search(least: float, kind: type):
    """Links of rows sorted by dim, shard, run and part: a graph stays while the blocks of its run pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = at = None
        for key, part, rows in pieces(batches):
            if part == GRAPH:
                shard, at = Shard.load(rows.combine_chunks().to_batches()[0], kind), key
            elif key == at:  # a dimension need not have vectors in every shard
                yield shard.found(rows.select(["cls", "raw"]), least, kind)

    return run


def near_vectors(df: DataFrame, cosine: float = COSINE, shard: int = SHARD, queries: int = QUERIES) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    return only(df.sparkSession, lambda: _near_vectors(df, cosine, shard, queries), "near_vectors")


def _near_vectors(df: DataFrame, cosine: float, shard: int, queries: int) -> DataFrame:
    kind = precision(df)
    rows = written(vectors(df), "vectors")
    classes = rows.filter("dim > 0").groupBy("dim", "cls").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("raw").alias("raw"))
    classes = written(classes, "vector_classes")
    n = classes.count()
    shards, parts = max(SHARDS, -(-n // shard)), max(1, -(-n // queries))
    placed = classes.withColumn("shard", F.pmod(F.xxhash64("cls", F.lit(1)), F.lit(shards)).cast("int"))
    index = placed.select("dim", "shard", "cls", "copies", "raw").groupBy("dim", "shard").applyInArrow(build(kind), "dim int, shard int, graph binary, ids binary, copies binary, raws binary")
    # a graph has megabytes: row groups are cut by their size, not after a hundred rows
    index = written(index, "graphs", {"parquet.page.size.row.check.min": "1"})
    runs = min(parts, max(1, -(-RUNS // shards)))
    part = F.pmod(F.xxhash64("cls", F.lit(2)), F.lit(parts)).cast("int")
    asked = classes.select("dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(part, F.lit(runs)).alias("run"), part.alias("part"), "cls", "raw")
    offered = index.mapInArrow(lent(runs), "dim int, shard int, graph binary, ids binary, copies binary, raws binary, run int, part int")
    both = asked.unionByName(offered, allowMissingColumns=True).repartition("dim", "shard", "run").sortWithinPartitions("dim", "shard", "run", "part")
    found = written(both.mapInArrow(search(cosine, kind), FOUND), "vector_links")
    counted = found.groupBy("cls").agg(F.sum("links").alias("links"))
    joined = components(found.filter("cls != other").select(F.col("cls").alias("u"), F.col("other").alias("v"))).withColumnRenamed("id", "cls")
    named = classes.select("cls", "least", "copies").join(counted, "cls", "left").join(joined, "cls", "left").withColumn("component", F.coalesce("component", "cls"))
    heads = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(heads, "component").select("cls", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = salted_join(rows.filter("dim > 0").select("vec_id", "cls"), written(named, "named_vectors"), ["cls"], "copies").select("vec_id", "n_links", "component_id")
    alone = rows.filter("dim = 0").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, cosine of 0.95 or more."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
