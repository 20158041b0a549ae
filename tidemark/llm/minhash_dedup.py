"""MinHash near-dedup: the chosen-path set similarity join on sets of distinct word shingles.

Texts with equal sets become one class. A class has COORDINATES minwise values. TREES independent trees branch the
classes: a node picks BRANCHES coordinates by hash of its own number, and its classes go on to the children of their
values. A pair of similarity s follows each branch with probability s, so at 0.8 a tree of any depth holds it with
probability over 0.93 in a node small enough to be compared exhaustively, and all trees miss it with about 1e-6.
Nodes over NODE classes branch as tables, smaller ones inside a task. Similarity of compared classes is first estimated
from their values, with a margin of over five standard deviations, then confirmed on the full sets.

The first pass links classes to leaders of their node only, so that a group of near copies costs its size. The second
compares whatever isn't connected yet, exhaustively: the classes of a node that may have partners in other components
meet once more with their full sets, and give a link for each two components that join, never all pairs. What is too
large at the last level, or has too many shingles for a task, is compared in pairs of blocks.

Words are `[^\\x20\\x09-\\x0D]+`, A-Z made small; a text of fewer words than a shingle is one shingle; without words or
text the set is empty and links with nothing: n_shingles 0, component_id = doc_id, kept. Null doc_id: linked, but
component_id is the least non-null doc_id of its group, else null, and kept is false. Rows that repeat are of one class, and
kept where doc_id = component_id. Of equal minwise values or sizes the lower class number leads, which changes no
result. A text of any length is read in parts; its set of 8 bytes a shingle is held whole. An empty table gives an
empty result. Other columns, of any name, stay in deduplicated() and are ignored elsewhere. Shingles and sets are
compared as 64-bit hashes.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import document_keys, guarded, materialise, settle, small_batches
from .components import components
from .textops import mix, slices, utf8, whole_groups, word_hashes

WORDS, PERCENT = 2, 80
COORDINATES, TREES, BRANCHES = 64, 5, 2
#: Classes of a node that a task takes, and that it compares without branching; levels of tables and inside a task.
NODE, LEAF, LEVELS, DEPTH, BLOCK = 4000, 40, 12, 10, 1500
#: Comparisons of a node that are cheaper than branching it, and shingles of a group that come together; 16 MB.
DIRECT, TOGETHER = 4_000_000, 2_000_000
#: Estimated partners share this many of the coordinates at least.
SHARED = COORDINATES * PERCENT // 100 - math.ceil(5.5 * math.sqrt(COORDINATES * 0.16))
#: Ids that are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 500_000
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_ODD = np.uint64(0xD6E8FEB86659FD93)


def shingle_sets(data: np.ndarray, starts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct shingle hashes of all texts, text after text, and each one's start."""
    hashes, text = word_hashes(data, starts)
    n = len(starts) - 1
    count = np.bincount(text, minlength=n)
    # A shingle starts at every word that k - 1 of its text follow, or at the first of fewer.
    place = np.arange(len(hashes)) - (np.cumsum(count) - count)[text]
    begins = (place + k <= count[text]) | ((place == 0) & (count[text] < k))
    length = np.minimum(count[text], k)[begins]
    at = np.flatnonzero(begins)
    value = np.zeros(len(at), np.uint64)
    for j in range(k):
        inside = j < length
        value = np.where(inside, mix(value * _ODD + hashes[np.minimum(at + j, len(hashes) - 1)] + np.uint64(j + 1)), value) if len(at) else value
    own = text[at]
    order = np.lexsort((value, own))
    value, own = value[order], own[order]
    if len(value):
        new = np.ones(len(value), bool)
        new[1:] = (value[1:] != value[:-1]) | (own[1:] != own[:-1])
        value, own = value[new], own[new]
    return value, np.concatenate(([0], np.cumsum(np.bincount(own, minlength=n))))


def _set_ids(value: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A number for each set, from the sum of its mixed members and its size."""
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(value ^ _ODD), dtype=np.uint64)))
    return mix(total[start[1:]] - total[start[:-1]] + mix(np.diff(start).astype(np.uint64))).view(np.int64)


def signatures(docs: DataFrame, k: int = WORDS) -> DataFrame:
    """(doc_id, n, id, sig) of each row: set size, set number, minwise values as 16-bit numbers; id and sig are null without words."""
    small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            data, starts = utf8(batch.column(1))
            for first, last in slices(starts):
                value, start = shingle_sets(data[starts[first] : starts[last]], starts[first : last + 1] - starts[first], k)
                size = np.diff(start)
                some = np.flatnonzero(size)
                least = np.zeros((last - first, COORDINATES), np.uint16)
                if len(some):
                    for c in range(COORDINATES):
                        low = np.minimum.reduceat(value * _SEEDS[c], start[:-1][some])
                        least[some, c] = mix(low) >> np.uint64(48)
                empty = size == 0
                sig = pa.array([None if e else s.tobytes() for e, s in zip(empty.tolist(), least, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(size.astype(np.int64)), pa.array(_set_ids(value, start), mask=empty), sig], ["doc_id", "n", "id", "sig"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n long, id long, sig binary")


def _chosen(node: np.ndarray) -> list[np.ndarray]:
    """BRANCHES different coordinates of each node."""
    first = (mix(node ^ np.uint64(0xA5A5)) % np.uint64(COORDINATES)).astype(np.int64)
    step = (mix(node ^ np.uint64(0x5A5A)) % np.uint64(COORDINATES // BRANCHES - 1)).astype(np.int64) + 1
    return [(first + j * step) % COORDINATES for j in range(BRANCHES)]


def _children(node: np.ndarray, sig: np.ndarray) -> list[np.ndarray]:
    rows = np.arange(len(node))
    return [mix(mix(node + np.uint64(j + 1)) ^ (sig[rows, c].astype(np.uint64) + (c.astype(np.uint64) << np.uint64(20)))) for j, c in enumerate(_chosen(node))]


ROW = "node long, id long, n long, component long, sig binary"


def _sigs(column) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * COORDINATES * len(column) else np.uint8).reshape(-1, COORDINATES)


def _branch(rows: DataFrame) -> DataFrame:
    """The children of all rows. Roots branch by 16 bits of a value; rows go on with 8, which is enough below."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sig = _sigs(batch.column(4))
                lower = pa.array([s.tobytes() for s in sig.astype(np.uint8)], pa.binary())
                for child in _children(batch.column(0).to_numpy().view(np.uint64), sig):
                    yield pa.RecordBatch.from_arrays([pa.array(child.view(np.int64)), *batch.columns[1:4], lower], batch.schema.names)

    return rows.mapInArrow(run, ROW)


def _roots(classes: DataFrame) -> DataFrame:
    trees = mix(np.arange(1, TREES + 1, dtype=np.uint64) * _ODD).view(np.int64).tolist()
    root = F.explode(F.array(*[F.lit(t) for t in trees])).alias("node")
    return _branch(classes.select(root, "id", "n", "component", "sig"))


class _Node:
    """The classes of a node inside a task, and the pairs found among them."""

    def __init__(self, ids, sizes, component, sig, again: bool):
        self.ids, self.sizes, self.component, self.sig, self.again = ids, sizes, component, sig, again
        self.pairs: list[np.ndarray] = []
        self.groups: list[np.ndarray] = []
        self.serial = 0

    def near(self, one: int, others: np.ndarray) -> np.ndarray:
        """Which others may be partners, by size and shared coordinates."""
        n, m = self.sizes[one], self.sizes[others]
        out = 100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m)
        at = np.flatnonzero(out)
        out[at] = (self.sig[others[at]] == self.sig[one]).sum(axis=1) >= SHARED
        return out

    def pair(self, one: int, others: np.ndarray):
        if len(others):
            self.pairs.append(np.stack([np.full(len(others), self.ids[one]), self.ids[others]], axis=1))

    def lead(self, rows: np.ndarray, dense: float) -> np.ndarray:
        """Links rows to leaders and leaves them out, while a leader has the share ``dense`` of them; the rest."""
        while len(rows) > 1:
            hit = self.near(rows[0], rows[1:])
            self.pair(rows[0], rows[1:][hit])
            if hit.sum() < dense * (len(rows) - 1):
                return rows if dense else rows[1:][~hit]
            rows = rows[1:][~hit]
        return rows

    def leaders(self, rows: np.ndarray):
        while len(rows) > 1:
            rows = self.lead(rows, 0.0)

    def across(self, rows: np.ndarray):
        """Rows that may have partners in other components, as groups to be compared on full sets."""
        kinds, of, count = np.unique(self.component[rows], return_inverse=True, return_counts=True)
        if len(kinds) < 2:
            return
        touched, most = np.zeros(len(rows), bool), of == count.argmax()
        for i in np.flatnonzero(~most):
            others = np.flatnonzero(of != of[i])
            hit = others[self.near(rows[i], rows[others])]
            touched[hit] = True
            touched[i] |= len(hit) > 0
        rows = rows[touched]
        if not len(rows):
            return
        block = np.cumsum(self.sizes[rows]) // TOGETHER
        blocks = [rows[block == b] for b in np.unique(block)]
        for i, one in enumerate(blocks):
            for other in blocks[i + 1 :] or ([] if i else [one[:0]]):
                own = np.concatenate((one, other))
                self.groups.append(np.stack([np.full(len(own), self.serial), self.ids[own], self.component[own]], axis=1))
                self.serial += 1

    def walk(self, rows: np.ndarray, node: np.uint64, depth: int):
        if self.again:
            _, count = np.unique(self.component[rows], return_counts=True)
            if len(count) < 2:
                return
            if len(rows) <= LEAF or depth == DEPTH or (len(rows) - count.max()) * len(rows) <= DIRECT:
                return self.across(rows)
        else:
            if len(rows) > LEAF:
                rows = self.lead(rows, 0.25)
            if len(rows) <= LEAF or depth == DEPTH:
                return self.leaders(rows)
        for child in _children(np.full(len(rows), node, np.uint64), self.sig[rows]):
            order = np.argsort(child, kind="stable")
            cuts = np.flatnonzero(np.diff(child[order])) + 1
            for part in np.split(order, cuts):
                if len(part) > 1:
                    self.walk(rows[part], child[part[0]], depth + 1)


def _search(rows: DataFrame, again: bool, deep: bool) -> DataFrame:
    """From rows in whose nodes no more than a task's classes are: (a, b) that may be partners, or again (g, id, component) of groups."""

    def run(batches):
        with np.errstate(over="ignore"):
            for batch in whole_groups(batches):
                node, ids, sizes = (batch.column(i).to_numpy() for i in range(3))
                component, sig = batch.column(3).to_numpy(), _sigs(batch.column(4))
                found = []
                cut = np.flatnonzero(np.diff(node)) + 1
                for part in np.split(np.arange(len(node)), cut):
                    if len(part) > 1:
                        n = _Node(ids, sizes, component, sig, again)
                        n.walk(part[np.argsort(ids[part], kind="stable")], node[part[0]].view(np.uint64), DEPTH if deep else 0)
                        for g in n.groups:
                            g[:, 0] = mix(mix(node[part[0]].view(np.uint64)) + g[:, 0].astype(np.uint64)).view(np.int64)
                        found += n.groups if again else n.pairs
                if found:
                    p = np.concatenate(found)
                    if not again:
                        p = np.sort(p, axis=1)
                        p = np.unique(p[p[:, 0] != p[:, 1]], axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in p.T], ["g", "id", "component"] if again else ["a", "b"])

    schema = "g long, id long, component long" if again else "a long, b long"
    return rows.repartition("node").sortWithinPartitions("node").mapInArrow(run, schema)


def candidates(classes: DataFrame, again: bool) -> DataFrame:
    """Distinct (a, b), a < b, of all trees; again: groups (g, id, component) with all that may be partners across components."""
    rows, found = _roots(classes), None
    for level in range(LEVELS + 1):
        large = materialise(rows.groupBy("node").count().filter(F.col("count") > NODE), "minhash-large")
        if not large.isEmpty():
            small = rows.join(large, "node", "left_anti")
            rest = rows.join(large.select("node", "count"), "node")
        else:
            small, rest = rows, None
        part = _search(small.select("node", "id", "n", "component", "sig"), again, False)
        found = part if found is None else found.unionByName(part)
        if rest is None:
            break
        if level < LEVELS:
            rows = materialise(_branch(rest.select("node", "id", "n", "component", "sig")), "minhash-level")
        else:
            found = found.unionByName(_search(_blocks(rest), again, True))
    return found.distinct()


def _blocks(rest: DataFrame) -> DataFrame:
    """Nodes that never became small, as pairs of blocks: each class meets every block of its node."""
    blocks = F.ceil(F.col("count") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    r = rest.withColumn("blocks", blocks).withColumn("own", own)
    r = r.select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return r.select(F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("node"), "id", "n", "component", "sig")


def _members(ids: DataFrame, classes: DataFrame, docs: DataFrame, k: int) -> DataFrame:
    """(id, members) of classes: their full sets. Only texts of those classes are read into sets, one a class."""
    wanted = materialise(classes.join(ids, "id").select("id", "least"), "minhash-wanted")
    nobody = F.lit(-(1 << 63))
    keys = wanted.select(F.coalesce("least", nobody).alias("__key")).distinct()
    if wanted.count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), nobody).alias("__key"), F.col("text").cast("string").alias("text")).join(keys, "__key", "left_semi")

    def sets(batches):
        for batch in batches:
            data, starts = utf8(batch.column(0))
            for first, last in slices(starts):
                value, start = shingle_sets(data[starts[first] : starts[last]], starts[first : last + 1] - starts[first], k)
                raw = [value[a:b].tobytes() for a, b in zip(start[:-1], start[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_set_ids(value, start)), pa.array(raw, pa.binary())], ["id", "members"])

    members = texts.select("text").mapInArrow(sets, "id long, members binary").join(wanted.select("id"), "id", "left_semi")
    return materialise(members.dropDuplicates(["id"]), "minhash-sets")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs whose full sets have the similarity."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    members = _members(ids, classes, docs, k)
    both = pairs.join(members.select(F.col("id").alias("a"), F.col("members").alias("x")), "a").join(members.select(F.col("id").alias("b"), F.col("members").alias("y")), "b")

    def check(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
                    good.append(False)
                    continue
                shared = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * shared >= percent * (len(a) + len(b) - shared))
            keep = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def joining_links(ids: np.ndarray, component: np.ndarray, sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Exact links of a group that join components, one for each two that join. Shared members are counted by inverted lists."""
    size = np.array([len(x) for x in sets])
    _, member = np.unique(np.concatenate(sets), return_inverse=True)
    holder = np.repeat(np.arange(len(sets)), size)[np.argsort(member, kind="stable")]
    list_at = np.concatenate(([0], np.cumsum(np.bincount(member))))
    at = np.concatenate(([0], np.cumsum(size)))
    _, root, count = np.unique(component, return_inverse=True, return_counts=True)
    links = []
    for i in np.flatnonzero(root != count.argmax()):
        own = member[at[i] : at[i + 1]]
        shared = np.bincount(np.concatenate([holder[list_at[m] : list_at[m + 1]] for m in own.tolist()]), minlength=len(sets))
        near = np.flatnonzero((100 * shared >= percent * (size + size[i] - shared)) & (root != root[i]))
        for j in near[np.unique(root[near], return_index=True)[1]].tolist():
            links.append((int(ids[i]), int(ids[j])))
            root[root == root[j]] = root[i]
    return links


def _joined(groups: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b) of exact links that join components."""
    members = _members(groups.select("id").distinct(), classes, docs, k)

    def run(batches):
        for batch in whole_groups(batches):
            group, ids, component = (batch.column(i).to_numpy() for i in range(3))
            links: list[tuple[int, int]] = []
            for part in np.split(np.arange(len(group)), np.flatnonzero(np.diff(group)) + 1):
                sets = [np.frombuffer(x, np.uint64) for x in batch.column(3).take(pa.array(part)).to_pylist()]
                links += joining_links(ids[part], component[part], sets, percent)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], ["a", "b"])

    together = groups.join(members, "id").select("g", "id", "component", "members").repartition("g").sortWithinPartitions("g", "id")
    return together.mapInArrow(run, "a long, b long").distinct()


def near_groups(docs: DataFrame, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row, as a table."""
    return settle("minhash-result", lambda: _near_groups(docs, k, percent))


def _near_groups(docs: DataFrame, k: int, percent: int) -> DataFrame:
    rows = materialise(signatures(docs, k), "minhash-rows")
    grouped = rows.filter(F.col("id").isNotNull()).groupBy("id").agg(F.min("n").alias("n"), F.min("sig").alias("sig"), F.min("doc_id").alias("least"))
    classes = materialise(grouped.withColumn("component", F.col("id")), "minhash-classes")
    pairs = materialise(candidates(classes, again=False), "minhash-pairs")
    links = materialise(_confirmed(pairs, classes, docs, k, percent), "minhash-links")
    first = components(links)
    placed = classes.drop("component").join(first, F.col("id") == F.col("node"), "left")
    placed = materialise(placed.select("id", "n", "sig", "least", F.coalesce("component", "id").alias("component")), "minhash-classes")
    more = materialise(candidates(placed, again=True), "minhash-groups")
    if not more.isEmpty():
        links = links.unionByName(_joined(more, classes, docs, k, percent))
        first = components(links)
    groups = classes.select("id", "least").join(first, F.col("id") == F.col("node"), "left").select("id", "least", F.coalesce("component", "id").alias("component"))
    lowest = groups.groupBy("component").agg(F.min("least").alias("lowest"))
    known = groups.join(lowest, "component").select("id", "lowest")
    out = rows.select("doc_id", "n", "id").join(known, "id", "left")
    component = F.when(F.col("id").isNull(), F.col("doc_id")).otherwise(F.col("lowest"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each group, that of its least doc_id; all columns stay.

    A row without doc_id stands for its text, behind all with one. Rows with one doc_id and different texts are
    different documents, in the order of their texts' hashes; of rows that repeat both one stays. Rows without words are
    alike to nothing and stay.
    """
    return guarded(docs, lambda d: _deduplicated(d, k, percent))


def _deduplicated(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    behind = F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))), 2) + F.lit(1 << 62)
    keyed = document_keys(docs, F.coalesce(F.col("doc_id").cast("long"), behind), "__key")
    near = near_groups(keyed.select(F.col("__key").alias("doc_id"), "text"), k, percent)
    keys = near.groupBy(F.col("doc_id").alias("__key")).agg(F.count_if("kept").alias("n"))
    gone = keys.filter("n = 0").select("__key")
    if gone.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    out = keyed.join(gone, "__key", "left_anti")
    repeated = not keys.filter("n > 1").isEmpty()
    return (out.dropDuplicates(["__key"]) if repeated else out).select(*docs.columns)


#: The query's rows by comparing all pairs.
ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id AND r.c < e.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT m.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id, component_id = m.doc_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""
