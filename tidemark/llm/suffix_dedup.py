"""Suffix-array dedup: every byte in a string of LENGTH bytes that also starts earlier goes, by bucket-pointer refinement.

The suffixes of a text that start a window of LENGTH bytes are those that a repeat may start at. A window is told by
its anchor, the q-gram of least hash in it; equal windows have equal anchors at equal places. Neighbouring windows with
one anchor make a stretch. So the initial q-gram buckets are the anchors' buckets, one shuffle of a row a stretch:

1. Stretches of a bucket that are equal as a whole have equal windows; all but the earliest go.
2. A bucket with several different stretches is refined. Its stretches' bytes come together, windows get identifiers
   of their first 8 bytes, and buckets are sorted again and again on the identifiers of later offsets, 8, 16, 32 bytes
   on, each step using the last one's identifiers, until they tell LENGTH bytes apart. A bucket of one is final.
3. A bucket with more than HOT different stretches, such as what surrounds a very common passage, isn't gathered in a
   task: its windows are shuffled one by one by their hash instead, and told apart as in 1. Anchors that a sample of
   the texts finds very common are dealt by their stretches from the start, and go that way at once. The sample only
   decides how work is dealt.

A match never crosses documents. "Earlier" is by doc_id, then start; null doc_id is before all others. Null or empty
text: 0 bytes, nothing removed, the hash of nothing. A document is a doc_id with a text: rows that repeat both are one
document, judged alike and not earlier than one another; rows with one doc_id, or none, and different texts are
different documents, in the order of their texts' 64-bit hashes. An empty table gives an empty result, other columns
are ignored. Texts are used whole, long ones in parts of SLICE bytes that overlap, so that a task's memory doesn't grow
with a text but for its bytes; anchors and stretches are compared as 64-bit hashes, refined windows byte by byte.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import document_keys, materialise, settle, small_batches
from .textops import SLICE, mix, prefix_hashes, slices, stretch, utf8, whole_groups

LENGTH, GRAM = 100, 40
#: Stretches of a bucket that are refined in a task; about 3 MB.
HOT = 20_000
#: Of one in SAMPLE texts, anchors that occur OFTEN times are very common; their list is bounded by COMMON.
SAMPLE, OFTEN, COMMON = 32, 64, 10_000
#: Marks a very common anchor's stretch beside its number of windows.
MARK = 128
#: Ids that are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 500_000
FIRST = -(1 << 63)
LOW = np.uint64(0xFFFFFFFF)
ROW = "h long, s long, doc long, at long"  # at: start << 8 | MARK or 0 | windows; below 0, -1 - that of a stretch to remove
NAMES = ["h", "s", "doc", "at"]


def _sliding_least(key: np.ndarray, width: int) -> np.ndarray:
    step, least = 1, key
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    rest = width - step
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def stretches(data: np.ndarray, starts: np.ndarray, length: int = LENGTH, q: int = GRAM):
    """Anchor hash, hash, first window and number of windows of each stretch, and its text's number."""
    n = len(data)
    if n < length:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none.view(np.uint64), none, none, none
    prefix = prefix_hashes(data)
    i = np.arange(n - q + 1)
    grams = stretch(prefix, i, i + q)
    # The upper half of a hash, then the place, so that the leftmost of equal grams is least.
    least = _sliding_least((grams & ~LOW) | i.astype(np.uint64), length - q + 1)
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    inside = np.flatnonzero(np.arange(n - length + 1) + length <= starts[1:][text[: n - length + 1]])
    anchor = (least[inside] & LOW).astype(np.int64)
    new = np.ones(len(inside), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (inside[1:] != inside[:-1] + 1)
    at = np.flatnonzero(new)
    begin, count = inside[at], np.diff(np.append(at, len(inside)))
    place = (anchor[at] - begin).astype(np.uint64)
    whole = mix(stretch(prefix, begin, begin + count - 1 + length) ^ mix(place * np.uint64(1024) + count.astype(np.uint64)))
    return grams[anchor[at]], whole, begin, count, text[begin]


def _stretches_of(data: np.ndarray, starts: np.ndarray):
    """Stretches of some texts at a time, as stretches() gives them, with places in the text and its number; a long text goes in parts."""
    for first, last in slices(starts):
        low, high = int(starts[first]), int(starts[last])
        if last > first + 1 or high - low <= 2 * SLICE:
            h, s, begin, count, text = stretches(data[low:high], starts[first : last + 1] - low)
            yield h, s, begin - (starts[first:last] - low)[text], count, text + first
            continue
        for at in range(low, high - LENGTH + 1, SLICE):  # windows that start in the part
            end = min(at + SLICE + LENGTH - 1, high)
            h, s, begin, count, text = stretches(data[at:end], np.array([0, end - at]))
            yield h, s, begin + (at - low), count, text + first


def _earliest(h: np.ndarray, s: np.ndarray, doc: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Of rows that are equal as a whole, all but the earliest as removals, dealt to places of their own."""
    order = np.lexsort((at, doc, s, h))
    h, s, doc, at = h[order], s[order], doc[order], at[order]
    head = np.ones(len(h), bool)
    head[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
    group = np.cumsum(head) - 1
    first = np.flatnonzero(head)[group] if len(h) else group
    again = (doc != doc[first]) | (at != at[first])
    alone = mix(mix(doc.view(np.uint64)) ^ at.view(np.uint64)).view(np.int64)
    keep = head | again  # a repeated row is neither
    out = np.where(again, alone, h), np.where(again, alone, s), doc, np.where(again, -1 - at, at)
    return [c[keep] for c in out]


def _common(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of very common anchors."""

    def run(batches):
        for batch in batches:
            data, starts = utf8(batch.column(0))
            for h, *_ in _stretches_of(data, starts):
                found, n = np.unique(h.view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["h", "n"])

    some = docs.filter(F.pmod(F.xxhash64("doc", F.lit("anchors")), F.lit(SAMPLE)) == 0).select("text")
    counts = some.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= OFTEN)
    return np.sort(counts.orderBy(F.desc("n"), "h").limit(COMMON).select("h").toPandas()["h"].to_numpy(np.int64))


def _rows(docs: DataFrame, common: np.ndarray) -> DataFrame:
    def run(batches):
        with np.errstate(over="ignore"):
            for batch in batches:
                ids = batch.column(0).to_numpy()
                data, starts = utf8(batch.column(1))
                parts = []
                for h, s, begin, count, text in _stretches_of(data, starts):
                    often = np.isin(h.view(np.int64), common)
                    h = np.where(often, mix(h ^ s), h)
                    at = (begin << 8) | count | np.where(often, MARK, 0)
                    parts.append((h.view(np.int64), s.view(np.int64), ids[text], at))
                if parts:
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in _earliest(*(np.concatenate(c) for c in zip(*parts, strict=True)))], NAMES)

    return docs.mapInArrow(run, ROW)


FOUND = "h long, doc long, start long, end long, windows long"  # windows: 0 to remove start to end, else a stretch to refine, with MARK


def _found(h, doc, start, end, windows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in (h, doc, start, end, windows)], ["h", "doc", "start", "end", "windows"])


def _judge(batches):
    """Sorted rows, streamed: later ones of equal stretches are removals; first ones of a bucket with others are to be refined."""
    held, shared, last = None, False, None  # the latest first row, whether its bucket has others, the latest row
    for batch in batches:
        h, s, doc, at = (batch.column(i).to_numpy() for i in range(4))
        gone = at < 0
        take = at[gone]
        raw = -1 - take
        out = [(h[gone], doc[gone], raw >> 8, (raw >> 8) + (raw & (MARK - 1)) - 1 + LENGTH, np.zeros(len(raw), np.int64))]
        h, s, doc, at = h[~gone], s[~gone], doc[~gone], at[~gone]
        if len(h):
            if last is not None:
                h, s, doc, at = (np.concatenate(([x], c)) for x, c in zip(last, (h, s, doc, at), strict=True))
            head = np.ones(len(h), bool)
            head[1:] = (h[1:] != h[:-1]) | (s[1:] != s[:-1])
            skip = 0 if last is None else 1  # the row carried over is judged already
            if skip:
                head[0] = False
            group = np.maximum.accumulate(np.where(head, np.arange(len(h)), -1))
            first_doc = np.where(group < 0, held[2] if held else 0, doc[group])
            first_at = np.where(group < 0, held[3] if held else 0, at[group])
            later = ~head & ((doc != first_doc) | (at != first_at))
            later[:skip] = False
            start = at[later] >> 8
            out.append((h[later], doc[later], start, start + (at[later] & (MARK - 1)) - 1 + LENGTH, np.zeros(later.sum(), np.int64)))
            firsts = [c[head] for c in (h, s, doc, at)]
            if held is not None:
                firsts = [np.concatenate(([x], c)) for x, c in zip(held, firsts, strict=True)]
            same = firsts[0][1:] == firsts[0][:-1]
            several = np.append(False, same) | np.append(same, False)
            several[0] |= shared and held is not None
            several |= (firsts[3] & MARK) > 0
            done = slice(0, len(several) - 1)
            pick = np.flatnonzero(several[done])
            begin = firsts[3][pick] >> 8
            out.append((firsts[0][pick], firsts[2][pick], begin, begin, firsts[3][pick] & 255))
            held, shared = tuple(int(c[-1]) for c in firsts), bool(several[-1])
            last = int(h[-1]), int(s[-1]), int(doc[-1]), int(at[-1])
        yield _found(*(np.concatenate(c) for c in zip(*out, strict=True)))
    if held is not None and shared:
        yield _found([held[0]], [held[2]], [held[3] >> 8], [held[3] >> 8], [held[3] & 255])


def _sorted(rows: DataFrame) -> DataFrame:
    return rows.repartition("h").sortWithinPartitions("h", "s", "doc", "at")


def refined(data: np.ndarray, begin: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Identifiers of the ``length`` bytes from each place of ``begin``, equal for equal bytes, by bucket-pointer refinement.

    Places near the end of data count as followed by zeros. Each pass sorts buckets of more than one suffix on the
    identifiers that the pass before gave ``reach`` bytes on; buckets of one keep theirs.
    """
    n = len(data)
    padded = np.concatenate((data, np.zeros(length + 8, np.uint8)))
    grams = np.lib.stride_tricks.sliding_window_view(padded, 8)[: n + length]
    _, bucket = np.unique(np.ascontiguousarray(grams).view(np.uint64).ravel(), return_inverse=True)
    reach = 8
    while reach < length:
        step = min(reach, length - reach)
        size = np.bincount(bucket)
        open_ = np.flatnonzero(size[bucket[:n]] > 1)
        if not len(open_):
            break
        pointer = bucket[np.minimum(open_ + step, len(bucket) - 1)]
        _, inverse = np.unique(bucket[open_].astype(np.int64) * (int(bucket.max()) + 1) + pointer, return_inverse=True)
        bucket = bucket.copy()
        bucket[open_] = inverse + len(size)
        _, bucket = np.unique(bucket, return_inverse=True)
        reach += step
    return bucket[begin]


def _refine(batches):
    """Whole buckets of stretches with their bytes, sorted: the windows that an earlier one of the bucket equals."""
    for batch in whole_groups(batches):
        bucket, doc, start, windows = (batch.column(i).to_numpy() for i in range(4))
        lengths = windows + LENGTH - 1
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        cut = np.append(np.flatnonzero(np.diff(bucket)) + 1, len(bucket))
        raw, done = batch.column(4), 0
        while done < len(bucket):  # some buckets at once, about a million bytes
            end = int(cut[min(max(np.searchsorted(cut, np.searchsorted(offsets, offsets[done] + 1_000_000)), np.searchsorted(cut, done, "right")), len(cut) - 1)])
            data = np.frombuffer(b"".join(raw.slice(done, end - done).to_pylist()), np.uint8)
            w = windows[done:end]
            row = np.repeat(np.arange(end - done), w)
            nth = np.arange(len(row)) - (np.cumsum(w) - w)[row]
            ident = refined(data, (offsets[done:end] - offsets[done])[row] + nth)
            own, at = doc[done:end][row], start[done:end][row] + nth
            order = np.lexsort((at, own, ident, bucket[done:end][row]))
            i, b, o, a = ident[order], bucket[done:end][row][order], own[order], at[order]
            head = np.ones(len(i), bool)
            head[1:] = (i[1:] != i[:-1]) | (b[1:] != b[:-1])
            first = np.flatnonzero(head)[np.cumsum(head) - 1]
            again = (o != o[first]) | (a != a[first])
            yield _found(b[again], o[again], a[again], a[again] + LENGTH, np.zeros(again.sum(), np.int64))
            done = end


def _texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc, text) of the given distinct ids."""
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.join(wanted, "doc", "left_semi").dropDuplicates(["doc"])


def _windows_alone(batches):
    """Every window of listed stretches as a row with its own hash as bucket."""
    with np.errstate(over="ignore"):
        for batch in batches:
            for doc, raw, listed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = np.frombuffer((raw or "").encode(), np.uint8)
                every = np.sort(np.concatenate([np.arange(x >> 8, (x >> 8) + (x & 255)) for x in listed]))
                for low in range(int(every[0]) // SLICE * SLICE, int(every[-1]) + 1, SLICE):
                    at = every[np.searchsorted(every, low) : np.searchsorted(every, low + SLICE)]
                    key = stretch(prefix_hashes(data[low : low + SLICE + LENGTH]), at - low, at - low + LENGTH).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(key), pa.array(np.full(len(at), doc)), pa.array((at << 8) | 1)], NAMES)


def _stretch_bytes(batches):
    """The bytes of listed stretches, with their buckets."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for doc, raw, listed in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            data = (raw or "").encode()
            for h, x in ((y["h"], y["at"]) for y in listed):
                start, windows = x >> 8, x & 255
                for column, value in zip(out, (h, doc, start, windows, data[start : start + windows - 1 + LENGTH]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], ["h", "doc", "start", "windows", "bytes"])


def removals(docs: DataFrame) -> DataFrame:
    """(doc, start, end) of strings to remove, which overlap, from (doc, text)."""
    small_batches(docs.sparkSession)
    found = materialise(_sorted(_rows(docs, _common(docs))).mapInArrow(_judge, FOUND), "suffix-found")
    out = found.filter(F.col("windows") == 0).select("doc", "start", "end")
    refine = found.filter(F.col("windows") > 0).select("h", "doc", (F.shiftleft("start", 8) + F.col("windows")).alias("at"))
    if refine.isEmpty():
        return out
    refine, marked = refine.filter(F.col("at").bitwiseAND(MARK) == 0), refine.filter(F.col("at").bitwiseAND(MARK) != 0)
    hot = materialise(refine.groupBy("h").count().filter(F.col("count") > HOT).select("h"), "suffix-hot")
    some = refine if hot.isEmpty() else refine.join(hot, "h", "left_anti")
    listed = some.groupBy("doc").agg(F.collect_list(F.struct("h", "at")).alias("listed"))
    texts = _texts_of(docs, listed.select("doc"))
    own = texts.join(listed, "doc").select("doc", "text", "listed").mapInArrow(_stretch_bytes, "h long, doc long, start long, windows long, bytes binary")
    ours = own.repartition("h").sortWithinPartitions("h").mapInArrow(_refine, FOUND)
    out = out.unionByName(ours.select("doc", "start", "end"))
    many = marked if hot.isEmpty() else marked.unionByName(refine.join(hot, "h", "left_semi"))
    if not many.isEmpty():
        many = many.groupBy("doc").agg(F.collect_list(F.col("at") - F.col("at").bitwiseAND(MARK)).alias("listed"))
        alone = _texts_of(docs, many.select("doc")).join(many, "doc").select("doc", "text", "listed").mapInArrow(_windows_alone, ROW)
        theirs = _sorted(alone).mapInArrow(_judge, FOUND).filter(F.col("windows") == 0)
        out = out.unionByName(theirs.select("doc", "start", "end"))
    return out


def without(data: bytes, spans: np.ndarray) -> tuple[bytes, int, int]:
    """What is left without spans (start, end), and the numbers of removed bytes and of maximal runs."""
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.ones(len(spans), bool)
    new[1:] = spans[1:, 0] > reach[:-1]
    begin, end = spans[new, 0], reach[np.append(np.flatnonzero(new)[1:] - 1, len(spans) - 1)]
    pieces, at = [], 0
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        pieces.append(data[at:a])
        at = b
    pieces.append(data[at:])
    return b"".join(pieces), int((end - begin).sum()), len(begin)


def _cut(batches):
    for batch in batches:
        rows: list[list] = [[], [], [], []]
        for doc, raw, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            s = np.array(spans, np.int64)
            left, removed, n = without((raw or "").encode(), np.stack([s >> 32, s & 0xFFFFFFFF], axis=1))
            for column, value in zip(rows, (doc, removed, n, hashlib.sha256(left).hexdigest()), strict=True):
                column.append(value)
        yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in rows[:3]), pa.array(rows[3], pa.string())], ["doc", "removed", "spans", "sha"])


def repeats_removed(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each row, as a table."""
    return settle("suffix-result", lambda: _repeats_removed(docs))


def _repeats_removed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    d = document_keys(docs.select("doc_id", text), F.coalesce(F.col("doc_id").cast("long"), F.lit(FIRST)), "doc")
    found = removals(d.select("doc", "text"))
    spans = found.groupBy("doc").agg(F.collect_list(F.shiftleft("start", 32) + F.col("end")).alias("spans"))
    spans = materialise(spans, "suffix-spans")
    cut = _texts_of(d.select("doc", "text"), spans.select("doc")).join(spans, "doc").select("doc", "text", "spans")
    cut = cut.mapInArrow(_cut, "doc long, removed long, spans long, sha string")
    whole = d.select("doc_id", "doc", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("all_sha"))
    zero = F.lit(0).cast("long")
    return whole.join(cut, "doc", "left").select(
        "doc_id", "n_bytes", F.coalesce("removed", zero).alias("n_removed"), F.coalesce("spans", zero).alias("n_spans"), F.coalesce("sha", "all_sha").alias("kept_sha256")
    )
