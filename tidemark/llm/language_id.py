"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, every run of others becomes one blank, and 1- to 3-grams of code points are hashed to BUCKETS.
Document frequencies cover every training document. The weights are fitted by follow-the-regularised-leader with an
elastic net on a bounded sample of labelled documents (about SAMPLE, drawn by hash, equally by language where there are
enough, and LEAST of each language); a part of the sample is left out to fit one temperature, which calibrates the scores.
Every language of the training documents is learned: the driver takes 0.5 MB and an executor 0.13 MB for each, and a
sampled document up to 0.2 MB in the driver, if it is so long that it has every n-gram.

Learned from: text and non-null lang where crc32(doc_id as text) mod 3 isn't 1. Text null or without a letter: `und`,
score 0. No training documents: `und`, score 0 for all. Null doc_id: never learned from, held_out is false. Repeated
rows: each is learned from and predicted. Equal scores: the first language by code point. Whole texts are used, of any
length; a text's counts take no more memory than BUCKETS numbers beside its own letters. Empty tables give empty
results. Other columns, of any name, stay in filtered() and are ignored elsewhere.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import crc_mod, guarded, small_batches

BITS = 15
BUCKETS = 1 << BITS
#: About how many labelled documents the weights are fitted on; LEAST of each language at least, where it has them.
SAMPLE, LEAST = 4000, 20
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 1e-3, 1e-4, 4
UNKNOWN = "und"
_letters: list[np.ndarray] = []


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, blanks between; empty without letters."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters[0][codes]
    if not letter.any():
        return codes[:0]
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    return np.concatenate(([32], np.where(letter, codes, 32)[keep], [32])).astype(np.uint64)


def counts(text: str | None) -> np.ndarray | None:
    """How often each bucket occurs in a text; None without letters."""
    codes = _codes(text) if text else ()
    if not len(codes):
        return None
    with np.errstate(over="ignore"):
        one = codes * np.uint64(0x9E3779B97F4A7C15)
        two = (one[:-1] ^ codes[1:]) * np.uint64(0xC2B2AE3D27D4EB4F)
        three = (two[:-1] ^ codes[2:]) * np.uint64(0x165667B19E3779F9)
    shift = np.uint64(64 - BITS)
    found = np.concatenate([one, two, three]) >> shift
    return np.bincount(found.astype(np.int64), minlength=BUCKETS)


def training(docs: DataFrame) -> DataFrame:
    chosen = (crc_mod(F.col("doc_id"), 3) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).filter(chosen)


def document_frequencies(train: DataFrame) -> tuple[np.ndarray, int]:
    """In how many training documents each bucket occurs, and the number of documents. Each task sends one row a bucket."""

    def count(batches):
        seen, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                c = counts(text)
                if c is not None:
                    seen[c > 0] += 1
                    n += 1
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(seen[at], n))], ["bucket", "n"])

    rows = train.select("text").mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1)
    df[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return df[:-1], int(df[-1])


def sample(train: DataFrame, most: int = SAMPLE) -> pd.DataFrame:
    """lang, and bucket numbers with their counts, of at most about ``most`` documents drawn by hash."""
    langs = train.groupBy("lang").count().collect()
    if not langs:
        return pd.DataFrame({"lang": [], "draw": [], "at": [], "n": []})
    draw = F.pmod(F.xxhash64("doc_id", F.lit("lid")), F.lit(1 << 30)) / float(1 << 30)
    limits = train.sparkSession.createDataFrame([(r["lang"], max(LEAST, most / len(langs)) / r["count"]) for r in langs], "lang string, limit double")
    chosen = train.withColumn("draw", draw).join(F.broadcast(limits), "lang").filter(F.col("draw") < F.col("limit")).select("lang", "draw", "text")

    def sparse(batches):
        for batch in batches:
            lang, draws, at, n = [], [], [], []
            for a, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                c = counts(text)
                if c is not None:
                    where = np.flatnonzero(c)
                    lang.append(a), draws.append(b), at.append(where.astype("<u2").tobytes()), n.append(c[where].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(draws, pa.float64()), pa.array(at, pa.binary()), pa.array(n, pa.binary())], ["lang", "draw", "at", "n"])

    found = chosen.mapInArrow(sparse, "lang string, draw double, at binary, n binary").toPandas()
    found["order"] = [hash_bytes(a, n) for a, n in zip(found["at"], found["n"], strict=True)]
    return found.sort_values(["order", "lang"], kind="stable").reset_index(drop=True)


def hash_bytes(*parts: bytes) -> int:
    import zlib

    value = 0
    for p in parts:
        value = zlib.crc32(p, value)
    return value


def _probabilities(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], n_classes: int) -> tuple[np.ndarray, float]:
    """Weights (classes, BUCKETS + 1 for the bias) by FTRL-proximal steps, and the temperature. rows: buckets, unit values, class."""
    z, n = np.zeros((n_classes, BUCKETS + 1)), np.zeros((n_classes, BUCKETS + 1))
    kept = rows[: max(n_classes, len(rows) * 4 // 5)]

    def weights(at):
        zi = z[:, at]
        return np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + np.sqrt(n[:, at])) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, x, y in kept:
            w = weights(at)
            p = _probabilities(w @ x)
            p[y] -= 1.0
            g = p[:, None] * x[None, :]
            grown = n[:, at] + g * g
            z[:, at] += g - (np.sqrt(grown) - np.sqrt(n[:, at])) / ALPHA * w
            n[:, at] = grown
    every = weights(np.arange(BUCKETS + 1))
    left = rows[len(kept) :] or kept
    logits, classes = np.array([every[:, at] @ x for at, x, _ in left]), np.array([y for _, _, y in left])
    loss = lambda t: -np.log(_probabilities(logits / t)[np.arange(len(left)), classes] + 1e-12).mean()
    low, high = np.log(0.02), np.log(20.0)
    for _ in range(60):  # golden section over the logarithm
        a, b = high - 0.618034 * (high - low), low + 0.618034 * (high - low)
        low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
    return every, float(np.exp((low + high) / 2))


def _unit(at: np.ndarray, n: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = (1.0 + np.log(n)) * idf[at]
    x /= np.sqrt((x * x).sum())
    return np.append(at, BUCKETS), np.append(x, 1.0)


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray, float]:
    """Languages, weights, inverse document frequencies and temperature."""
    small_batches(docs.sparkSession)
    train = training(docs)
    df, total = document_frequencies(train)
    idf = np.log((1.0 + total) / (1.0 + df)) + 1.0
    chosen = sample(train)
    langs = sorted(set(chosen["lang"]))
    if not langs:
        return [], np.zeros((0, BUCKETS + 1)), idf, 1.0
    number = {x: i for i, x in enumerate(langs)}
    rows = [(*_unit(np.frombuffer(a, "<u2").astype(np.int64), np.frombuffer(n, "<f4").astype(float), idf), number[x]) for x, a, n in zip(chosen["lang"], chosen["at"], chosen["n"], strict=True)]
    first = {y: i for i, (_, _, y) in reversed(list(enumerate(rows)))}  # goes to the front, so that no language is left out
    rows = [rows[i] for i in sorted(first.values())] + [r for i, r in enumerate(rows) if i != first[r[2]]]
    weights, temperature = fit(rows, len(langs))
    return langs, weights.astype(np.float32), idf.astype(np.float32), temperature


def predict(docs: DataFrame, model=None, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of docs, with __lid_lang and __lid_score, in one pass over the texts."""
    langs, weights, idf, temperature = model or learn(docs)
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    sent = docs.sparkSession.sparkContext.broadcast((weights, idf))  # 131 KB a language
    schema = docs.select(*keep).schema.add("__lid_lang", "string").add("__lid_score", "double")

    def classify(batches):
        w, f = sent.value
        for batch in batches:
            lang, score = [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                c = counts(t) if langs else None
                if c is None:
                    lang.append(UNKNOWN), score.append(0.0)
                    continue
                at = np.flatnonzero(c)
                where, x = _unit(at, c[at].astype(np.float32), f)
                p = _probabilities(w[:, where] @ x / temperature)
                lang.append(langs[int(p.argmax())]), score.append(float(p.max()))
            columns = batch.columns[: len(keep)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*keep, "__lid_lang", "__lid_score"])

    return docs.select(*keep, F.col(text).cast("string").alias("__lid_text")).mapInArrow(classify, schema)


def language_of_documents(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each document."""
    found = predict(docs.select("doc_id", "text", "lang"), keep=["doc_id"])
    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return found.select("doc_id", held.alias("held_out"), F.col("__lid_lang").alias("lang_pred"), F.col("__lid_score").alias("score"))


def filtered(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """docs without those that no language was found for with a score of ``least``; all columns stay."""
    return guarded(docs, lambda d: _filtered(d, least))


def _filtered(docs: DataFrame, least: float = 0.4) -> DataFrame:
    known = (F.col("__lid_lang") != UNKNOWN) & (F.col("__lid_score") >= least)
    return predict(docs).filter(known).select(*docs.columns)
