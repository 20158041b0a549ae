"""Embedding near-dedup: an exact metric range join of equally labelled vectors by cosine.

On unit vectors cosine >= s is Euclidean distance <= r = sqrt(2 - 2 s). Equal vectors become one class. Pivots, drawn by
hash, split a label's classes into cells by the nearest pivot p; a class x is also sent to every cell of a pivot q with
d(x, q) <= d(x, p) + 2 r and d(x, q) <= radius(q) + r. By the triangle inequality each cell then holds all partners of
its own classes, so it counts their links alone, without other cells. Large cells are split into blocks of CELL classes,
which get the cell's other blocks as replicas too; replicas are streamed past a block, so its memory is bounded. A cell
gives its classes' numbers of links and a spanning forest of them, not the pairs.

Vectors that are null, zero, or hold null or non-finite components, and rows with null label or null vec_id link with
nothing: n_links 0, component_id = vec_id, kept (false where vec_id is null). Only vectors of equal length link. Repeated
rows link with each other as other vectors. A vector as near to two pivots is of the lower one's cell, which changes no
result. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise, settle, small_batches
from .components import components

COSINE = 0.98
#: Classes in a block, and pivots of all labels together, which go to every executor.
CELL, PIVOTS = 2000, 4096
SLACK = 1e-9


def _classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows with their class key, and one row a class: its least vec_id, vector and number of rows."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    good = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite, F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), e.alias("v"), good.alias("good"))
    rows = rows.withColumns({"k1": F.when(F.col("good"), F.xxhash64("v")), "k2": F.when(F.col("good"), F.xxhash64(F.lit(7), "v"))})
    classes = rows.filter("good").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("mult"), F.min("v").alias("v"))
    return rows.select("vec_id", "label", "k1", "k2"), classes.select("id", "mult", "label", F.size("v").alias("dim"), "k1", "k2", "v")


def _matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    m = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)
    largest = np.abs(m).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    m = m / largest
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _groups(batch_keys: list[np.ndarray]) -> list[np.ndarray]:
    order = np.lexsort(batch_keys[::-1])
    changed = np.zeros(len(order), bool)
    for k in batch_keys:
        changed[1:] |= k[order][1:] != k[order][:-1]
    return np.split(order, np.flatnonzero(changed))


def _pivots(classes: DataFrame, cell: int) -> dict[tuple, np.ndarray]:
    """Unit pivots of each (label, dim) with more than ``cell`` classes; some are drawn by hash, PIVOTS at most in expectation."""
    sizes = classes.groupBy("label", "dim").count().filter(F.col("count") > cell)
    total = sizes.agg(F.sum(F.ceil(F.col("count") / cell))).first()[0] or 0
    share = F.least(F.lit(1.0), F.ceil(F.col("count") / cell) / F.col("count") * min(1.0, PIVOTS / max(1, total)))
    draw = F.pmod(F.xxhash64("k1", F.lit(3)), F.lit(1 << 30)) / float(1 << 30)
    drawn = classes.join(sizes, ["label", "dim"]).filter(draw < share).select("label", "dim", "id", "v").collect()
    found: dict[tuple, list] = {}
    for r in sorted(drawn, key=lambda r: (r["label"], r["dim"], r["id"])):
        found.setdefault((r["label"], r["dim"]), []).append(r["v"])
    return {k: _matrix(pa.array(v, pa.list_(pa.float64()))) for k, v in found.items()}


def _assign(classes: DataFrame, pivots: dict, r: float) -> DataFrame:
    """Each class's nearest pivot, its distance, and the pivots that the hyperplane bound doesn't exclude, with distances."""

    def nearest(batches):
        for batch in batches:
            label, dim = batch.column("label").to_numpy(zero_copy_only=False), batch.column("dim").to_numpy()
            n = batch.num_rows
            own, at, near, dist = np.zeros(n, np.int32), np.zeros(n), [[0]] * n, [[0.0]] * n
            for rows in _groups([label, dim]) if n else []:
                p = pivots.get((label[rows[0]].item(), dim[rows[0]].item()))
                if p is None:
                    continue
                x = _matrix(batch.column("v").take(pa.array(rows)))
                d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (x @ p.T)))
                best = d.argmin(axis=1)
                own[rows], at[rows] = best, d[np.arange(len(rows)), best]
                for i, row in enumerate(rows):
                    reach = np.flatnonzero(d[i] <= at[row] + 2 * r + SLACK)
                    near[row], dist[row] = reach.tolist(), d[i, reach].tolist()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "mult", "label", "dim", "v")), pa.array(own, pa.int32()), pa.array(at), pa.array(near, pa.list_(pa.int32())), pa.array(dist, pa.list_(pa.float64()))],
                ["id", "mult", "label", "dim", "v", "own", "at", "near", "dist"],
            )

    kind = classes.schema["label"].dataType.simpleString()
    return classes.select("id", "mult", "label", "dim", "v").mapInArrow(nearest, f"id long, mult long, label {kind}, dim int, v array<double>, own int, at double, near array<int>, dist array<double>")


class _Forest:
    """Classes of a block, united when they share a partner."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def unite(self, members: np.ndarray) -> list[int]:
        """The old roots that went into the least one."""
        roots = np.unique(self.root[members])
        for old in roots[1:]:
            self.root[self.root == old] = roots[0]
        return roots.tolist()


def _join_block(cosine: float):
    """Batches sorted by block, own classes first: a row (id, n_links, other) a class, and (id, null, other) a forest link."""

    def links(own: np.ndarray, other: np.ndarray):
        for at in range(0, len(other), 2048):
            yield at, own @ other[at : at + 2048].T >= cosine

    def run(batches):
        key, own, ids, mult, counts, forest, out = None, None, None, None, None, None, []

        def add(x, y_ids, y_mult, same):
            nonlocal counts
            made = []
            for at, hit in links(own, x):
                if same:
                    hit[np.arange(at, at + hit.shape[1]), np.arange(hit.shape[1])] = False
                counts += hit @ y_mult[at : at + hit.shape[1]]
                for j in np.flatnonzero(hit.any(axis=0)):
                    members = np.flatnonzero(hit[:, j])
                    if same:
                        members = np.append(members, at + j)
                    else:
                        made.append((ids[members[0]], y_ids[at + j]))
                    if (forest.root[members] != forest.root[members[0]]).any():
                        first, *rest = forest.unite(members)
                        made += [(ids[first], ids[k]) for k in rest]
            return made

        def closed():
            if key is not None:
                out.append((ids.tolist(), (counts + mult - 1).tolist(), [None] * len(ids)))

        def flush():
            columns = [sum((o[i] for o in out), []) for i in range(3)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "n_links", "other"])

        pending: list = []

        def start():
            nonlocal own, ids, mult, counts, forest, pending
            own, ids, mult = (np.concatenate([p[i] for p in pending]) for i in range(3))
            counts, forest, pending = np.zeros(len(ids), np.int64), _Forest(len(ids)), []
            return add(own, ids, mult, True)

        def emit(pairs):
            if pairs:
                out.append(([int(a) for a, _ in pairs], [None] * len(pairs), [int(b) for _, b in pairs]))

        for batch in batches:
            block = batch.column("block").to_numpy()
            replica = batch.column("replica").to_numpy()
            for rows in np.split(np.arange(len(block)), np.flatnonzero((block[1:] != block[:-1]) | (replica[1:] != replica[:-1])) + 1) if len(block) else []:
                if block[rows[0]] != key:
                    if pending:
                        emit(start())
                    closed()
                    key, own, ids, mult, counts = block[rows[0]], None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
                part = batch.slice(rows[0], len(rows))
                x = _matrix(part.column("v"))
                values = x, part.column("id").to_numpy(), part.column("mult").to_numpy()
                if not replica[rows[0]]:
                    pending.append(values)
                else:
                    if pending:
                        emit(start())
                    if own is not None:
                        emit(add(*values, False))
            if out:
                yield flush()
        if pending:
            emit(start())
        closed()
        if out:
            yield flush()

    return run


def linked(vectors: DataFrame, cosine: float = COSINE, cell: int = CELL) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows with class keys, classes, and the join's rows: (id, n_links, null) a class, (id, null, other) a forest link."""
    small_batches(vectors.sparkSession, 1000)
    rows, classes = _classes(vectors)
    classes = materialise(classes, "vector-classes")
    r = math.sqrt(max(0.0, 2.0 - 2.0 * cosine))
    pivots = _pivots(classes, cell)
    assigned = materialise(_assign(classes, pivots, r), "vector-cells")
    cells = assigned.groupBy("label", "dim", F.col("own").alias("cell")).agg(F.max("at").alias("radius"), F.ceil(F.count(F.lit(1)) / cell).cast("int").alias("blocks"))
    target = F.explode(F.arrays_zip(F.col("near").alias("cell"), F.col("dist").alias("d"))).alias("t")
    sent = assigned.select("id", "mult", "label", "dim", "v", "own", target).withColumn("cell", F.col("t.cell"))
    sent = sent.join(cells, ["label", "dim", "cell"]).filter((F.col("cell") == F.col("own")) | (F.col("t.d") <= F.col("radius") + r + SLACK))
    home = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    sent = sent.select("id", "mult", "label", "dim", "v", "own", "cell", home.alias("home"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"))
    replica = (F.col("cell") != F.col("own")) | (F.col("b") != F.col("home"))
    sent = sent.select("id", "mult", "v", F.xxhash64("label", "dim", "cell", "b").alias("block"), replica.cast("int").alias("replica"))
    joined = sent.repartition("block").sortWithinPartitions("block", "replica", "id").mapInArrow(_join_block(cosine), "id long, n_links long, other long")
    return rows, classes, materialise(joined, "vector-links")


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of each row, as a table."""
    return settle("vector-result", lambda: _near_vectors(vectors))


def _near_vectors(vectors: DataFrame) -> DataFrame:
    rows, classes, joined = linked(vectors)
    groups = components(joined.filter(F.col("other").isNotNull()).select(F.col("id").alias("a"), F.col("other").alias("b")))
    numbers = joined.filter(F.col("n_links").isNotNull()).select("id", "n_links")
    known = classes.select("label", "k1", "k2", "id").join(numbers, "id").join(groups, F.col("id") == F.col("node"), "left")
    known = known.select("label", "k1", "k2", "n_links", F.coalesce("component", "id").alias("component"))
    out = rows.join(known, ["label", "k1", "k2"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))


#: The query's rows by comparing all pairs.
ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT *, sqrt(list_inner_product(e, e)) AS z FROM v WHERE label IS NOT NULL AND e IS NOT NULL),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND a.z > 0 AND b.z > 0 WHERE list_inner_product(a.e, b.e) / (a.z * b.z) >= 0.98),
r(vec_id, c) AS (SELECT vec_id, vec_id FROM v UNION SELECT l.b, r.c FROM r JOIN l ON l.a = r.vec_id AND r.c < l.b),
m AS (SELECT vec_id, min(c) AS component_id FROM r GROUP BY vec_id), k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, component_id = vec_id AS kept FROM m LEFT JOIN k USING (vec_id)
"""
