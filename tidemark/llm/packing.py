"""Best-fit packing of token pieces into sequences, with bounds that certify each partition's number of bins.

A document's tokens are its ids by the tokenizer file, then END. Only longer documents than ``capacity`` are cut, into
pieces of ``capacity``, the last of which may be shorter. Pieces are dealt to partitions of bounded size, each runs
best-fit decreasing. Dual feasible functions give a lower bound of its bins; a partition that uses no more is certified
and releases only its emptiest bin, one with a gap releases every bin that isn't nearly full. The released pieces are
dealt anew to fewer partitions and packed again, until all are in one or nothing gained.

Null or empty text: one piece of END alone. Null doc_id: packed like any other. Repeated rows: each is packed, as a
document of its own. Pieces of one length go by doc_id, piece and start; of bins with equal room the lowest is filled.
An empty table gives an empty result; other columns are ignored. Texts of any length are tokenized whole, word by word:
white space ends every match of the tokenizer's splitting pattern, so words between ASCII white space have the same ids
on their own.
"""

from __future__ import annotations

import math
import os
import string
import zlib
from array import array
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import materialise, settle, small_batches

CAPACITY, END, TOKENIZER = 2048, 0, "word_bpe_49k.json"
#: Pieces in a partition of best-fit decreasing; about 10 MB.
PART_ROWS = 50_000
#: Words whose ids a worker remembers; about 80 MB; each task begins anew.
MEMO_WORDS = 400_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = "part long, doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, released boolean, gap long"

MARKS = string.punctuation.encode()

_tokenizers: dict = {}


class Words:
    """The ids of texts as little-endian unsigned 32-bit bytes, with a bounded memory of words."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")]] = True
        self.memo: dict[bytes, bytes] = {}

    def learn(self, words: set[bytes]) -> None:
        """Ids of new words. A run of ASCII marks after a letter is always a unit of its own, so stems and marks are shared; special tokens' strings stay whole."""
        memo = self.memo
        if len(memo) + len(words) > MEMO_WORDS:
            memo.clear()
        plain = {w for w in words if w.isalpha()}
        ended, other = [], set()
        for w in words - plain:
            stem = w.rstrip(MARKS)
            if 0 < len(stem) < len(w) and b"<|" not in w and (stem[-1:].isalpha() or (stem[-1] > 127 and stem.decode()[-1].isalpha())):
                marks = w[len(stem) :]
                ended.append((w, stem, marks))
                (plain if stem.isalpha() else other).add(stem)
                other.add(marks)
            else:
                other.add(w)
        rest = []
        for w in other.difference(memo):
            (plain.add if w.decode().isalpha() else rest.append)(w)
        plain = list(plain.difference(memo))
        for at in range(0, len(plain), 2_000):
            rest += self._learn_letters(plain[at : at + 2_000])
        for at in range(0, len(rest), 2_000):
            some = rest[at : at + 2_000]
            for w, e in zip(some, self.tokenizer.encode_batch([w.decode() for w in some], add_special_tokens=False), strict=True):
                memo[w] = array("I", e.ids).tobytes()
        for w, stem, marks in ended:
            memo[w] = memo[stem] + memo[marks]

    def _learn_letters(self, words: list[bytes]) -> list[bytes]:
        """Words of letters are one unit of the tokenizer each, so their ids end at the ids with a word end. Those not learned."""
        ids = np.array(self.tokenizer.encode(b" ".join(words).decode(), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words):
            return words
        raw, cuts = ids.tobytes(), (4 * ends).tolist()
        self.memo.update(zip(words, (raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))
        return []

    def of(self, texts: list[str | None]) -> list[bytes]:
        split = [_words(t) for t in texts]
        every = set(chain.from_iterable(split))
        if len(every) > MEMO_WORDS // 4 and len(texts) > 1:
            half = len(texts) // 2
            return self.of(texts[:half]) + self.of(texts[half:])
        if missing := every.difference(self.memo):
            self.learn(missing)
            if missing := every.difference(self.memo):  # the memory was full and is empty but for the new ones
                self.learn(missing)
        return [b"".join(map(self.memo.__getitem__, ws)) for ws in split]


def _words(text: str | None) -> list[bytes]:
    """What lies between ASCII white space. A-Z become small, as the tokenizer does itself, unless marks may combine with them."""
    raw = (text or "").encode("utf-8", "replace")
    return (raw if b"\xcc" in raw or b"\xcd" in raw else raw.lower()).split()


def words_of(path: str) -> Words:
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _tokenizers[path] = Words(path)
    return _tokenizers[path]


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document's pieces; the texts stay where they are."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    last, step = np.array([end], "<u4").tobytes(), 4 * capacity

    def cut(batches):
        words = words_of(path)
        for batch in batches:
            rows: list[list] = [[], [], [], [], []]
            for doc, ids in zip(batch.column(0).to_pylist(), words.of(batch.column(1).to_pylist()), strict=True):
                ids += last
                for k, at in enumerate(range(0, len(ids), step)):
                    own = ids[at : at + step]
                    for column, value in zip(rows, (doc, k, at // 4, len(own) // 4, zlib.crc32(own)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)
        words.memo.clear()  # a worker outlives its tasks

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best bound of bins by dual feasible functions.

    For each threshold t up to half the capacity: items over capacity - t count as a whole bin, items under t as
    nothing, others as themselves. And for each k: the rounding function floor((k + 1) x / C), over k, where x k + x
    isn't a multiple of C, else x / C.
    """
    if not len(lengths):
        return 0
    counts = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best, number, size = 0, np.cumsum(counts), np.cumsum(counts * x)
    for t in range(capacity // 2 + 1):
        middle = size[capacity - t] - (size[t - 1] if t else 0)
        best = max(best, int(number[capacity] - number[capacity - t]) + math.ceil(middle / capacity))
    for k in range(1, 21):
        scaled = (k + 1) * x
        value = np.where(scaled % capacity == 0, x * k, (scaled // capacity) * capacity)
        best = max(best, math.ceil(int((counts * value).sum()) / (k * capacity)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each item, taken in the given order, and the room left in each bin.

    The bins with each amount of room are in lists; a bit mask of the amounts that occur finds the tightest in one step.
    """
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask, room = 0, []
    for i, n in enumerate(lengths.tolist()):
        fitting = mask >> n
        if fitting:
            r = n + (fitting & -fitting).bit_length() - 1
            b = with_room[r].pop()
            if not with_room[r]:
                mask &= ~(1 << r)
        else:
            r, b = capacity, len(room)
            room.append(capacity)
        bins[i], offsets[i] = b, capacity - r
        room[b] = r = r - n
        if r:
            with_room[r].append(b)
            mask |= 1 << r
    return bins, offsets, np.array(room, np.int64)


def _pack_round(pieces: DataFrame, parts: int, round_: int, capacity: int, final: bool) -> DataFrame:
    base = round_ << 56

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "piece", "start"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        lengths = pdf["length"].to_numpy(np.int64)
        bins, offsets, room = best_fit(lengths, capacity)
        gap = len(room) - lower_bound(lengths, capacity)
        free = room * (8 if gap else 0) > capacity
        free[np.argmax(room)] |= room.max() > 0
        part = int(pdf["part"].iloc[0])
        return pdf.assign(bin=base + (part << 24) + bins, offset=offsets, released=free[bins] & (not final), gap=gap)

    dealt = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", F.lit(round_), F.rand(round_)), F.lit(parts)))
    columns = ["part", "doc_id", "piece", "start", "length", "ids_crc32"]
    return dealt.select(*columns).groupBy("part").applyInPandas(pack, PACKED)


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = PART_ROWS, rounds: int = 8) -> DataFrame:
    """Sequence and offset of every piece, as a table. Each round's is written, so a lost executor can't deal pieces twice."""
    return settle("pack-result", lambda: _pack(pieces, capacity, part_rows, rounds))


def _pack(pieces: DataFrame, capacity: int, part_rows: int, rounds: int) -> DataFrame:
    pool = materialise(pieces, "pack-pieces")
    full = pool.filter(F.col("length") == capacity).withColumns({"bin": F.xxhash64("doc_id", "piece"), "offset": F.lit(0).cast("long"), "gap": F.lit(0).cast("long")})
    keep = ["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "gap"]
    rest = pool.filter(F.col("length") < capacity)
    placed, n = [], rest.count()
    for round_ in range(1, rounds + 1):
        parts = max(1, math.ceil(n / part_rows))
        done = materialise(_pack_round(rest, parts, round_, capacity, parts == 1 or round_ == rounds), f"pack-{round_}")
        placed.append(done.filter(~F.col("released")).select(*keep))
        rest = done.filter("released")
        left = rest.count()
        if parts == 1 or not left:
            break
        n = min(left, (parts - 1) * part_rows)
    # A full piece is a sequence by itself; its number is drawn from row positions, so that repeated rows differ.
    full = full.withColumn("bin", F.monotonically_increasing_id())
    out = full.select(*keep)
    for p in placed:
        out = out.unionByName(p)
    return out.withColumnsRenamed({"bin": "sequence_id", "gap": "bins_above_bound"})


def packed_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of each piece, as a table; then bins_above_bound.

    That is how many sequences more than the certified lower bound the piece's partition had in the round that placed it: 0
    means that no packing of that partition has fewer.
    """
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    return settle("pack-result", lambda: pack(token_pieces(docs, path, capacity), capacity))
