"""LM scoring: a gated recurrent word model with class-factored softmax, next to a smoothed unigram base.

Counts of all training tokens are aggregated as 64-bit word hashes. The VOCABULARY most frequent words and one unknown
word are the model's outputs, in CLASSES classes of about equal mass; an unknown word's probability is the model's for
the unknown word times its smoothed share among such words, so that every text has a probability.

Training: every token of each training document, once. Documents are dealt by hash to as many trainers as the tokens
need, and to ROUNDS; after each round all trainers' weights are averaged by their tokens, level by level, and the next
round starts from there. A trainer streams its documents through LANES lanes, WINDOW tokens of each at a time, in
truncated backpropagation over segments of SEGMENT tokens. The state is carried from segment to segment and from window
to window until the document ends. Scoring carries the state through whole documents in the same way. Frequent counts go
to executors in a table of bounded size; rarer words of a document are joined with the counts by a shuffle.

Training documents: crc32(doc_id as text) mod 7 is not 2; a null doc_id is trained on and isn't held out. Null or empty
text: the end token alone. Rows that repeat are trained on and scored each. Without training tokens base_score is 0 for
N = V = 0 (log10 1) and the model is untrained. Words of one count: the lower hash goes first into the vocabulary. A long
text is read in parts and costs memory for its own tokens alone. An empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
from itertools import groupby, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, materialise, settle, small_batches
from .textops import mix, slices, utf8, word_hashes

VOCABULARY, CLASSES, EMBED, HIDDEN = 4096, 64, 16, 24
WINDOW, SEGMENT, LANES, ROUNDS, RATE = 32, 32, 128, 2, 0.08
#: Tokens of a trainer, of all rounds together, and weights that are averaged at once.
TRAINER, FAN = 8_000_000, 8
#: Documents of more tokens come first in a trainer, so that they don't hold its end up in a few lanes.
LONG = 400
#: Words whose counts every executor holds; about 10 MB.
LOOKUP = 262_144
#: Tokens that are scored together, in up to SCORE_LANES lanes.
SCORE_TOKENS, SCORE_LANES = 3_000_000, 512
END = np.uint64(1)


def tokens(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text's end token included, and where each text's begin."""
    hashes, text = word_hashes(data, starts)
    n = len(starts) - 1
    count = np.bincount(text, minlength=n)
    begin = np.concatenate(([0], np.cumsum(count + 1)))
    out = np.full(begin[-1], END, np.uint64)
    out[np.arange(len(hashes)) + text] = hashes
    return out, begin


class Table:
    """Numbers of 64-bit keys by open addressing; -1 for others."""

    def __init__(self, keys: np.ndarray):
        bits = max(4, int(len(keys)).bit_length() + 2)
        self.mask = (1 << bits) - 1
        self.keys, self.numbers = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.numbers[slot] < 0
            self.numbers[slot[free]] = left[free]  # of several one wins
            won = self.numbers[slot] == left
            self.keys[slot[won]] = keys[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys & np.uint64(self.mask)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        at, slot = np.arange(len(keys)), self._slot(keys)
        while len(at):
            number = self.numbers[slot]
            hit = (number >= 0) & (self.keys[slot] == keys[at])
            out[at[hit]] = number[hit]
            more = (number >= 0) & ~hit
            at, slot = at[more], (slot[more] + 1) & self.mask
        return out


def count_tokens(train: DataFrame) -> DataFrame:
    """(h, n) of all tokens of (text). A task adds up its own counts before they are shuffled."""

    def run(batches):
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def merged():
            keys = np.concatenate([k for k, _ in kept])
            unique, inverse = np.unique(keys, return_inverse=True)
            return unique, np.bincount(inverse, np.concatenate([n for _, n in kept]), len(unique)).astype(np.int64)

        def rows(part):
            return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1])], ["h", "n"])

        for batch in batches:
            data, starts = utf8(batch.column(0))
            for first, last in slices(starts):
                found, _ = tokens(data[starts[first] : starts[last]], starts[first : last + 1] - starts[first])
                kept.append(np.unique(found, return_counts=True))
            if sum(len(k) for k, _ in kept) > 1_500_000:
                kept[:] = [merged()]
                if len(kept[0][0]) > 1_000_000:
                    yield rows(kept.pop())
        if kept:
            yield rows(merged())

    return train.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Output numbers by falling mass, the unknown word among them, and their classes as ranges of numbers."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int, distinct: int):
        order = np.lexsort((hashes, -counts))
        self.lookup, self.counts = hashes[order], counts[order]
        k = min(VOCABULARY, len(order))
        inside = self.counts[:k]
        self.total, self.distinct = total, distinct
        #: Mass of unknown words with one for each and one for the unseen.
        self.rest = int(total - inside.sum()) + (distinct - k) + 1
        mass = np.concatenate(([max(1, total - inside.sum())], inside + 1)).astype(float)
        self.mass = mass / mass.sum()
        cumulated = np.cumsum(self.mass[1:]) - self.mass[1:] / 2
        kinds = 1 + np.floor((CLASSES - 1) * cumulated / max(1e-12, self.mass[1:].sum())).astype(int)
        self.kind = np.unique(np.concatenate(([0], kinds)), return_inverse=True)[1]
        self.cuts = np.concatenate(([0], np.flatnonzero(np.diff(self.kind)) + 1, [k + 1]))
        self.size, self.end = k + 1, 0
        where = np.flatnonzero(self.lookup[:k] == END)
        self.end = int(where[0]) + 1 if len(where) else 0

    def numbers(self, found: np.ndarray) -> np.ndarray:
        """Output numbers of places in the lookup; 0 is the unknown word."""
        return np.where((found >= 0) & (found < self.size - 1), found + 1, 0)


def _names(v: Vocabulary) -> list[tuple[str, tuple]]:
    h, c = HIDDEN, len(v.cuts) - 1
    return [("E", (v.size, EMBED)), ("Wx", (EMBED, 3 * h)), ("b", (3 * h,)), ("U", (h, 3 * h)), ("Wc", (h, c)), ("bc", (c,)), ("Wo", (v.size, h)), ("bo", (v.size,))]


def initial(v: Vocabulary) -> dict[str, np.ndarray]:
    """Small random weights; biases that give the unigram distribution."""
    rng = np.random.default_rng(11)
    w = {n: rng.normal(0, 0.1 if n in ("E", "Wx", "U") else 0.02, s).astype(np.float32) for n, s in _names(v)}
    kinds = np.add.reduceat(v.mass, v.cuts[:-1])
    w["b"][:] = 0
    w["bc"] = np.log(kinds).astype(np.float32)
    w["bo"] = np.log(v.mass / kinds[v.kind]).astype(np.float32)
    return w


def pack(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([x.ravel() for x in w.values()]).astype(np.float32)


def unpack(flat: np.ndarray, v: Vocabulary) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for name, shape in _names(v):
        n = math.prod(shape)
        out[name] = flat[at : at + n].reshape(shape).copy()
        at += n
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.minimum(x, 60.0, out=x)
    np.exp(x, out=x)
    x += 1.0
    return np.reciprocal(x, out=x)


def outputs(hidden: np.ndarray, y: np.ndarray, w: dict, v: Vocabulary, grads: dict | None = None):
    """Natural log probabilities of y, and with grads their gradient by hidden, added up in grads."""
    order = np.argsort(y, kind="stable")  # classes are ranges of numbers, so each one's tokens come together
    hidden, y = hidden[order], y[order]
    rows, kind = np.arange(len(y)), v.kind[y]
    one = np.concatenate([hidden, np.ones((len(y), 1), hidden.dtype)], axis=1)  # so that products take the biases along
    inner = np.concatenate([w["Wo"], w["bo"][:, None]], axis=1)
    n = hidden.shape[1]
    log = one @ np.concatenate([w["Wc"], w["bc"][None]])
    log -= log.max(axis=1, keepdims=True)
    p = np.exp(log)
    total = p.sum(axis=1)
    found = log[rows, kind].astype(np.float64) - np.log(total)
    back = grown = None
    if grads is not None:
        p /= total[:, None]
        p[rows, kind] -= 1.0
        both = one.T @ p
        grads["Wc"] += both[:n]
        grads["bc"] += both[n]
        back = p @ w["Wc"].T
        grown = np.zeros_like(inner)
    bounds = np.searchsorted(y, v.cuts)
    for c in np.flatnonzero((np.diff(bounds) > 0) & (np.diff(v.cuts) > 1)).tolist():
        a, b, first, last = v.cuts[c], v.cuts[c + 1], bounds[c], bounds[c + 1]
        h, inside = one[first:last], (rows[: last - first], y[first:last] - a)
        log = h @ inner[a:b].T
        log -= log.max(axis=1, keepdims=True)
        p = np.exp(log)
        total = p.sum(axis=1)
        found[first:last] += log[inside] - np.log(total)
        if grads is not None:
            p /= total[:, None]
            p[inside] -= 1.0
            np.matmul(p.T, h, out=grown[a:b])
            back[first:last] += p @ w["Wo"][a:b]
    if grads is not None:
        grads["Wo"] += grown[:, :n]
        grads["bo"] += grown[:, n]
    out = np.empty_like(found)
    out[order] = found
    if back is not None:
        unsorted = np.empty_like(back)
        unsorted[order] = back
        back = unsorted
    return out, back


def train_segment(w: dict, v: Vocabulary, x: np.ndarray, y: np.ndarray, h: np.ndarray) -> tuple[dict, np.ndarray, float]:
    """Gradients of one segment (time, lanes) from state h, the last state, and the mean log probability; y below 0 is no token.

    The gradient of E is (its rows that occur, their gradients).
    """
    steps, lanes = x.shape
    n = HIDDEN
    embedded = w["E"][x]
    gx = embedded @ w["Wx"]
    gx += w["b"]
    kind = gx.dtype
    hs, zr, new, us = np.empty((steps + 1, lanes, n), kind), np.empty((steps, lanes, 2 * n), kind), np.empty((steps, lanes, n), kind), np.empty((steps, lanes, 3 * n), kind)
    hs[0] = h
    for t in range(steps):
        u, gate, fresh = np.matmul(hs[t], w["U"], out=us[t]), zr[t], new[t]
        _sigmoid(np.add(gx[t, :, : 2 * n], u[:, : 2 * n], out=gate))
        np.multiply(gate[:, n:], u[:, 2 * n :], out=fresh)
        fresh += gx[t, :, 2 * n :]
        np.tanh(fresh, out=fresh)
        np.subtract(hs[t], fresh, out=hs[t + 1])
        hs[t + 1] *= gate[:, :n]
        hs[t + 1] += fresh
    grads = {k: np.zeros_like(a) for k, a in w.items() if k in ("Wc", "bc", "Wo", "bo")}
    hidden, flat = hs[1:].reshape(-1, n), y.ravel()
    valid = np.flatnonzero(flat >= 0)
    every = len(valid) == len(flat)
    logp, back = outputs(hidden if every else hidden[valid], flat if every else flat[valid], w, v, grads)
    if every:
        dh_out = back
    else:
        dh_out = np.zeros_like(hidden)
        dh_out[valid] = back
    dh_out = dh_out.reshape(steps, lanes, n)
    z, r, before = zr[:, :, :n], zr[:, :, n:], hs[:-1]
    # What a step multiplies the gradient of its state with, for all steps at once.
    by_new = (1 - z) * (1 - new * new)
    by_z = (before - new) * z * (1 - z)
    by_r = us[:, :, 2 * n :] * r * (1 - r)
    dgx, du, dh, back_u = np.empty_like(gx), np.empty_like(gx), np.zeros_like(hs[0]), np.ascontiguousarray(w["U"].T)
    for t in range(steps - 1, -1, -1):
        dh += dh_out[t]
        d, e = dgx[t], du[t]
        dnew = np.multiply(dh, by_new[t], out=d[:, 2 * n :])
        np.multiply(dh, by_z[t], out=d[:, :n])
        np.multiply(dnew, by_r[t], out=d[:, n : 2 * n])
        e[:, : 2 * n] = d[:, : 2 * n]
        np.multiply(dnew, r[t], out=e[:, 2 * n :])
        dh *= z[t]
        dh += e @ back_u
    flat_g, flat_x = dgx.reshape(-1, 3 * n), x.ravel()
    grads["U"] = before.reshape(-1, n).T @ du.reshape(-1, 3 * n)
    grads["b"] = flat_g.sum(axis=0)
    grads["Wx"] = embedded.reshape(-1, EMBED).T @ flat_g
    order = np.argsort(flat_x, kind="stable")
    ordered = flat_x[order]
    heads = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    grads["E"] = ordered[heads], np.add.reduceat((flat_g @ w["Wx"].T)[order], heads, axis=0)
    return grads, hs[-1], float(logp.sum() / max(1, len(valid)))


def _step(w: np.ndarray, squares: np.ndarray, g: np.ndarray, n: int, at=slice(None)) -> None:
    """Adagrad on rows ``at`` with the clipped mean of n tokens' gradients."""
    g /= n
    np.clip(g, -1.0, 1.0, out=g)
    grown = squares[at] + g * g
    squares[at] = grown
    g *= RATE
    g /= np.sqrt(grown, out=grown)
    w[at] -= g


def train_documents(w: dict, v: Vocabulary, docs, lanes: int = LANES) -> int:
    """Adagrad over all output numbers of each document, in place; the number of tokens. A lane that ends a document takes the next one."""
    squares, seen = {k: np.full_like(a, 1e-6) for k, a in w.items()}, 0
    docs, held, h = iter(docs), [], np.zeros((0, HIDDEN), np.float32)
    while True:
        going = [i for i, (d, at) in enumerate(held) if at < len(d)]
        fresh = [(d, 0) for d in islice(docs, lanes - len(going))]
        held = [held[i] for i in going] + fresh
        if not held:
            return seen
        h = np.concatenate([h[going], np.zeros((len(fresh), HIDDEN), np.float32)])
        y = np.full((len(held), WINDOW), -1, np.int16)
        for row, (d, at) in zip(y, held, strict=True):
            part = d[at : at + WINDOW]
            row[: len(part)] = part
        first = np.array([d[at - 1] if at else v.end for d, at in held], y.dtype)
        held = [(d, at + WINDOW) for d, at in held]
        y = np.ascontiguousarray(y.T)
        x = np.concatenate([first[None], np.maximum(y[:-1], 0)])
        for t in range(0, WINDOW, SEGMENT):
            part = y[t : t + SEGMENT]
            n = int((part >= 0).sum())
            if not n:
                break
            grads, h, _ = train_segment(w, v, x[t : t + SEGMENT], part, h)
            rows, g = grads.pop("E")
            _step(w["E"], squares["E"], g, n, rows)
            for k, g in grads.items():
                _step(w[k], squares[k], g, n)
            seen += n


def score_streams(w: dict, v: Vocabulary, docs: list[np.ndarray], lanes: int = SCORE_LANES) -> np.ndarray:
    """Natural log probability of each document's output numbers. Documents follow each other in lanes, longest first."""
    lengths = np.array([len(d) for d in docs])
    out = np.zeros(len(docs))
    if not len(docs):
        return out
    n_lanes = int(max(1, min(lanes, len(docs), 4 * lengths.sum() // max(1, lengths.max()))))
    streams: list[list[int]] = [[] for _ in range(n_lanes)]
    loads = [(0, i) for i in range(n_lanes)]
    for d in np.argsort(-lengths, kind="stable").tolist():
        load, i = heapq.heappop(loads)
        streams[i].append(d)
        heapq.heappush(loads, (load + int(lengths[d]), i))
    streams.sort(key=lambda s: -int(lengths[s].sum()))
    size = [int(lengths[s].sum()) for s in streams]
    steps = size[0]
    y, of, fresh = np.zeros((steps, n_lanes), np.int32), np.zeros((steps, n_lanes), np.int32), np.zeros((steps, n_lanes), bool)
    for i, s in enumerate(streams):
        y[: size[i], i] = np.concatenate([docs[d] for d in s])
        of[: size[i], i] = np.repeat(s, lengths[s])
        fresh[np.cumsum([0, *lengths[s][:-1].tolist()]), i] = True
    x = np.empty_like(y)
    x[1:], x[0] = y[:-1], v.end
    x[fresh] = v.end
    n, u = HIDDEN, w["U"]
    inputs = w["E"] @ w["Wx"] + w["b"]  # of every output number, so that a step only looks it up
    inputs[:, : 2 * n] *= -1
    u = np.concatenate([-u[:, : 2 * n], u[:, 2 * n :]], axis=1)
    active = np.searchsorted(-np.array(size), -np.arange(steps), "left")  # lanes that reach each step
    any_fresh = fresh.any(axis=1)
    h, chunk = np.zeros((n_lanes, n), np.float32), 64
    for at in range(0, steps, chunk):
        end, states = min(steps, at + chunk), []
        for t in range(at, end):
            k = active[t]
            h = h[:k]
            if any_fresh[t]:
                h = np.where(fresh[t, :k, None], np.float32(0), h)
            g, hu = inputs[x[t, :k]], h @ u
            zr = g[:, : 2 * n]
            zr += hu[:, : 2 * n]
            np.minimum(zr, 60.0, out=zr)
            np.exp(zr, out=zr)
            zr += 1.0
            np.reciprocal(zr, out=zr)
            new = hu[:, 2 * n :]
            new *= zr[:, n:]
            new += g[:, 2 * n :]
            np.tanh(new, out=new)
            h = new + zr[:, :n] * (h - new)
            states.append(h)
        counts = active[at:end]
        own = np.concatenate([y[t, : active[t]] for t in range(at, end)])
        whose = np.concatenate([of[t, : active[t]] for t in range(at, end)])
        logp, _ = outputs(np.concatenate(states), own, w, v)
        out += np.bincount(whose, logp, len(docs))
        assert counts.sum() == len(own)
    return out


def numbered(docs: DataFrame, v: Vocabulary) -> DataFrame:
    """Rows (doc_id, text, held_out) with their tokens' 16-bit output numbers (ids), what the lookup tells, and the words beyond it.

    row: a number of the row; key: hash of the text's ends and length; known and base: tokens of the lookup and the sum of
    log10(c + 1) of them; unknown and inside: tokens that are the model's unknown word, and that sum of them; rare and
    times: hashes of words beyond the lookup, with how often each occurs.
    """
    sent = docs.sparkSession.sparkContext.broadcast(v)
    names = ["row", "doc_id", "held_out", "key", "n_tokens", "known", "base", "unknown", "inside", "rare", "times", "ids"]
    kinds = "row long, doc_id long, held_out boolean, key long, n_tokens long, known long, base double, unknown long, inside double, rare array<long>, times array<int>, ids binary"

    def run(batches):
        v = sent.value
        table, logs = Table(v.lookup), np.log10(v.counts + 1.0)
        part, serial = TaskContext.get().partitionId(), 0
        for batch in batches:
            data, starts = utf8(batch.column(1))
            for first, last in slices(starts):
                found, begin = tokens(data[starts[first] : starts[last]], starts[first : last + 1] - starts[first])
                cuts, n, size = begin[:-1], np.diff(begin), last - first
                key = mix(found[cuts] ^ mix(found[np.maximum(begin[1:] - 2, cuts)]) ^ n.astype(np.uint64))
                at = table.find(found)
                value = np.where(at >= 0, logs[at], 0.0) if len(logs) else np.zeros(len(at))
                number = v.numbers(at).astype(np.int16)
                known, base = np.add.reduceat((at >= 0).astype(np.int64), cuts), np.add.reduceat(value, cuts)
                unknown, inside = np.add.reduceat((number == 0).astype(np.int64), cuts), np.add.reduceat(np.where(number == 0, value, 0.0), cuts)
                # Words beyond the lookup, counted by text.
                rare = np.flatnonzero(at < 0)
                whose, words = np.searchsorted(begin, rare, "right") - 1, found[rare]
                order = np.lexsort((words, whose))
                whose, words = whose[order], words[order]
                head = np.flatnonzero(np.concatenate(([True], (whose[1:] != whose[:-1]) | (words[1:] != words[:-1])))) if len(words) else order
                times = np.diff(np.append(head, len(words)))
                offsets = pa.array(np.searchsorted(whose[head], np.arange(size + 1)).astype(np.int32))
                own = pa.array([number[i:j].tobytes() for i, j in zip(cuts, begin[1:], strict=True)], pa.binary())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (words[head].view(np.int64), times.astype(np.int32))]
                columns = [pa.array(np.arange(serial, serial + size) + (part << 40)), batch.column(0).slice(first, size), batch.column(2).slice(first, size)]
                columns += [pa.array(c) for c in (key.view(np.int64), n, known, base, unknown, inside)] + [*lists, own]
                serial += size
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text", "held_out").mapInArrow(run, kinds)


def train_model(docs: DataFrame, v: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights after one pass over all tokens of the numbered documents: a part of them a round, averaged after each."""
    total = docs.agg(F.coalesce(F.sum("n_tokens"), F.lit(0))).first()[0]
    if not total:
        return initial(v)
    parts = -(-total // TRAINER)
    flat, spark = pack(initial(v)), docs.sparkSession
    # By content, so that a rerun learns the same; rows without id by their place too, so that copies are spread.
    place = F.xxhash64("key", "doc_id", F.when(F.col("doc_id").isNull(), F.col("row")))
    dealt = docs.select(F.pmod(place, F.lit(parts)).cast("int").alias("trainer"), F.pmod(F.xxhash64(place), F.lit(rounds)).alias("round"), (F.col("n_tokens") > LONG).alias("long"), "key", "doc_id", "ids")
    for round_ in range(rounds):
        sent = spark.sparkContext.broadcast(flat)

        def fit(batches, sent=sent):
            """A task's trainers, one after the other, and their average."""
            summed, seen = np.zeros(len(sent.value)), 0
            rows = ((t, i) for pdf in batches for t, i in zip(pdf["trainer"], pdf["ids"], strict=True))
            for _, own in groupby(rows, key=lambda r: r[0]):
                w = unpack(sent.value, v)
                n = train_documents(w, v, (np.frombuffer(i, np.int16) for _, i in own))
                summed += pack(w).astype(np.float64) * n
                seen += n
            if seen:
                yield pd.DataFrame({"part": [TaskContext.get().partitionId()], "n": [seen], "weights": [(summed / seen).astype(np.float32).tobytes()]})

        def average(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part")
            stacked = sum(np.frombuffer(x, np.float32).astype(np.float64) * n for x, n in zip(pdf["weights"], pdf["n"], strict=True))
            return pd.DataFrame({"part": [int(pdf["part"].min())], "n": [int(pdf["n"].sum())], "weights": [(stacked / pdf["n"].sum()).astype(np.float32).tobytes()]})

        kinds = "part int, n long, weights binary"
        own = dealt.filter(F.col("round") == round_).repartition(4 * parts, "trainer").sortWithinPartitions("trainer", F.desc("long"), "key", "doc_id", "ids").mapInPandas(fit, kinds)
        left = 4 * parts  # so many that most trainers have a partition of their own
        while left > FAN:  # a level of averages at a time, so that no task and not the driver gets more than some FAN weights
            left = -(-left // FAN)
            own = own.groupBy(F.pmod("part", F.lit(left)).cast("int").alias("g")).applyInPandas(average, kinds)
        got = own.toPandas()
        if len(got):
            flat = np.frombuffer(average(got)["weights"].iloc[0], np.float32)
    return unpack(flat, v)


def modelled(first: DataFrame, v: Vocabulary, model: dict[str, np.ndarray]) -> DataFrame:
    """Numbered rows, without ids, with model: the log10 probability of their output numbers."""
    sent = first.sparkSession.sparkContext.broadcast((v, pack(model)))
    keep = [c for c in first.columns if c not in ("ids", "key")]
    out = first.select(*keep).schema.add("model", "double")

    def run(batches):
        v, flat = sent.value
        w = unpack(flat, v)
        held: list[pa.RecordBatch] = []

        def flush():
            rows = pa.Table.from_batches(held).combine_chunks()
            held.clear()
            logp = score_streams(w, v, [np.frombuffer(x, np.int16) for x in rows.column(len(keep)).to_pylist()]) / math.log(10)
            yield from pa.Table.from_arrays([*rows.columns[: len(keep)], pa.array(logp)], [*keep, "model"]).to_batches()

        for batch in batches:
            held.append(batch)
            if sum(sum(b.column(keep.index("n_tokens")).to_pylist()) for b in held) > SCORE_TOKENS:
                yield from flush()
        if held:
            yield from flush()

    return first.select(*keep, "ids").mapInArrow(run, out)


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row, as a table."""
    return settle("lm-result", lambda: _scored(docs))


def _scored(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    held = F.coalesce(crc_mod(F.col("doc_id"), 7) == 2, F.lit(False))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), held.alias("held_out"))
    counts = materialise(count_tokens(d.filter(~F.col("held_out")).select("text")), "lm-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    levels = counts.groupBy("n").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("n")).limit(50_000).toPandas()
    fits = levels[levels["words"].cumsum() <= LOOKUP]
    least = int(fits["n"].min()) if len(fits) else 1 << 62
    frequent = counts.filter(F.col("n") >= least).toPandas()
    v = Vocabulary(frequent["h"].to_numpy(np.int64).view(np.uint64), frequent["n"].to_numpy(np.int64), int(total), int(distinct))
    first = materialise(numbered(d, v), "lm-numbered")
    second = materialise(modelled(first, v, train_model(first.filter(~F.col("held_out")), v)), "lm-scored")
    rare = second.select("row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("row", F.col("r.rare").alias("h"), F.col("r.times").alias("times"))
    joined = rare.join(counts.filter(F.col("n") < least), "h", "left")
    logs = F.sum(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + 1.0))
    tail = joined.groupBy("row").agg(logs.alias("logs"), F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("also"))
    out = second.select("row", "doc_id", "held_out", "n_tokens", "known", "base", "unknown", "inside", "model").join(tail, "row", "left")
    logs, also = F.coalesce("logs", F.lit(0.0)), F.coalesce("also", F.lit(0))
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + also).cast("long").alias("n_known"),
        F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("base") + logs - F.col("n_tokens") * math.log10(total + distinct + 1)).alias("base_score"),
        (F.col("model") + F.col("inside") + logs - F.col("unknown") * math.log10(v.rest)).alias("score"),
    )
