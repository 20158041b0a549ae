"""Retrieval over events: timeline, substring, BM25, exact vectors, reciprocal-rank fusion, neighbours and paging."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.text import escape_like, excerpt, fold_ascii, occurrences
from ..functions.vectors import FLAT, dot_literal, norm_of
from .ordered import beside

BRANCH, FUSION = 200, 60
K1, B = 1.2, 0.75


def bound(value: str | dt.datetime | None) -> Column | None:
    """A time bound as a literal in UTC; a naive one is UTC, an unreadable one is an error."""
    if value is None:
        return None
    at = value if isinstance(value, dt.datetime) else dt.datetime.fromisoformat(value)
    if at.tzinfo:
        at = at.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")


def overlapping(ev: DataFrame, start=None, end=None) -> DataFrame:
    """Events whose interval touches [start, end]; both ends count, either may be missing."""
    start, end = bound(start), bound(end)
    if start is not None:
        ev = ev.filter(F.col("ended_at") >= start)
    if end is not None:
        ev = ev.filter(F.col("started_at") <= end)
    return ev


def clamp(limit: int, most: int = 200) -> int:
    return max(1, min(limit, most))


HIT = ["id", "session_id", "started_at", "ended_at", "excerpt", "score", "exact_rank", "semantic_rank"]


def timeline(ev: DataFrame, start=None, end=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Newest first; id breaks ties. Texts are cut after the top rows are known."""
    page = overlapping(ev, start, end).orderBy(F.desc("started_at"), F.desc("id")).offset(offset).limit(clamp(limit))
    none = F.lit(None).cast("int")
    page = page.withColumns({"excerpt": excerpt(F.col("ocr_text")), "score": F.lit(0.0), "exact_rank": none, "semantic_rank": none})
    return page.select(*HIT)


def timeline_count(ev: DataFrame, start=None, end=None) -> DataFrame:
    return overlapping(ev, start, end).agg(F.count(F.lit(1)).alias("total"))


def like(ev: DataFrame, needle: str, start=None, end=None, limit: int = BRANCH) -> DataFrame:
    """Substring hits, newest first; only A-Z fold, and % and _ are ordinary."""
    folded = needle.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    hits = overlapping(ev, start, end).filter(fold_ascii(F.col("ocr_text")).contains(folded))
    return hits.orderBy(F.desc("started_at"), F.desc("id")).limit(limit)


def any_of(text: Column, tokens: list[str]) -> Column:
    """Holds one of the tokens in any case. A few byte searches are faster than one pattern of alternatives, many aren't."""
    low = F.lower(text)
    if len(tokens) > 4:
        return low.rlike("|".join(rf"\Q{t.lower()}\E" for t in tokens))
    return reduce(lambda a, b: a | b, [low.contains(t.lower()) for t in tokens], F.lit(False))


def match_any(ev: DataFrame, tokens: list[str]) -> DataFrame:
    """Events that hold one of the tokens of three characters and more."""
    return ev.filter(any_of(F.col("ocr_text"), [t for t in tokens if len(t) >= 3]))


def bm25(ev: DataFrame, tokens: list[str], start=None, end=None) -> DataFrame:
    """(id, bm25) of events with a token, lower is better. One scan gives the corpus statistics, a second the scores.

    A document's length is its number of trigrams; statistics cover all events, whatever the time filter is.
    """
    tokens = [t.lower() for t in tokens if len(t) >= 3]
    low, length = F.lower(F.col("ocr_text")), F.greatest(F.length("ocr_text") - 2, F.lit(0))
    if not tokens:
        return ev.select("id", F.lit(0.0).alias("bm25")).limit(0)
    stats = ev.select(length.alias("len"), *[low.contains(t).cast("int").alias(f"n{i}") for i, t in enumerate(tokens)])
    stats = stats.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(tokens))])
    row = stats.first()
    n, average = row["n"], row["avg_len"] or 1.0
    hits = overlapping(ev, start, end).filter(any_of(F.col("ocr_text"), tokens))
    score = F.lit(0.0)
    for i, t in enumerate(tokens):
        n_t = row[f"n{i}"] or 0
        idf = F.log(F.lit((n - n_t + 0.5) / (n_t + 0.5)))
        idf = F.when(idf <= 0, 1e-6).otherwise(idf)
        f = occurrences(low, t).cast("double")
        score = score + idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * length / average))
    return hits.select("id", F.round(-score, 6).alias("bm25"))


def exact_branch(ev: DataFrame, tokens: list[str], start=None, end=None, limit: int = BRANCH) -> DataFrame:
    """(id, exact_rank): BM25 hits of longer tokens, then newest substring hits of each shorter one, first place counts."""
    long_, short = [t for t in tokens if len(t) >= 3], [t for t in tokens if len(t) < 3]
    parts = []
    if long_:
        found = bm25(ev, long_, start, end).orderBy("bm25", "id").limit(limit)
        parts.append(found.select("id", F.lit(0).alias("branch"), F.row_number().over(W.orderBy("bm25", "id")).alias("place")))
    for i, t in enumerate(short if long_ else [" ".join(tokens)]):
        found = like(ev, t, start, end, limit).select("id", "started_at")
        parts.append(found.select("id", F.lit(i + 1).alias("branch"), F.row_number().over(W.orderBy(F.desc("started_at"), F.desc("id"))).alias("place")))
    every = reduce(DataFrame.unionByName, parts)
    first = every.groupBy("id").agg(F.min(F.struct("branch", "place")).alias("at"))
    first = first.orderBy("at", "id").limit(limit)
    return first.select("id", F.row_number().over(W.orderBy("at", "id")).alias("exact_rank"))


def vector_top(ev: DataFrame, query: list[float], start=None, end=None, limit: int = BRANCH) -> DataFrame:
    """(id, score, semantic_rank) of the nearest events; the query is of unit length, rows are made so.

    Time filters come before the limit, scores that aren't finite are dropped after it.
    """
    rows = overlapping(ev, start, end).filter(F.size("embedding") == len(query))
    if len(query) > FLAT:
        rows = nearest_in_batches(rows.select("id", "embedding"), query, limit)
    else:
        rows = rows.select("id", dot_literal("embedding", query).alias("dot"), norm_of("embedding", len(query)).alias("norm"))
        rows = rows.filter(F.col("norm") > 0).select("id", F.round(F.col("dot") / F.col("norm"), 6).alias("score"))
    top = rows.orderBy(F.desc("score"), "id").limit(limit)
    top = top.filter(~F.isnan("score") & (F.abs("score") < float("inf")))
    return top.withColumn("semantic_rank", F.row_number().over(W.orderBy(F.desc("score"), "id")))


def nearest_in_batches(rows: DataFrame, query: list[float], limit: int) -> DataFrame:
    """(id, score) of rows (id, embedding) of the query's dimension: the nearest of each Arrow batch, by one matrix product.

    Long vectors as columns of generated code are too large to be compiled; here a batch is one array.
    """
    import numpy as np
    import pyarrow as pa

    ask = np.array(query)

    def run(batches):
        for batch in batches:
            vectors = batch.column(1)
            flat = vectors.flatten()
            v = (flat.fill_null(float("nan")) if flat.null_count else flat).to_numpy(zero_copy_only=False).reshape(-1, len(ask)).astype(np.float64)
            ids, norm = batch.column(0).to_numpy(), np.sqrt(np.einsum("ij,ij->i", v, v))
            some = np.flatnonzero(~(norm <= 0))
            score = np.round(v[some] @ ask / norm[some], 6)
            best = some[np.lexsort((ids[some], -score))[:limit]] if len(some) else some
            kept = np.round(v[best] @ ask / norm[best], 6)
            yield pa.RecordBatch.from_arrays([pa.array(ids[best]), pa.array(kept)], ["id", "score"])

    return rows.mapInArrow(run, "id long, score double")


def fuse(exact: DataFrame, semantic: DataFrame) -> DataFrame:
    """(id, score, exact_rank, semantic_rank) by reciprocal ranks. Both sides hold BRANCH rows at most."""
    both = exact.join(semantic.select("id", "semantic_rank"), "id", "full")
    part = lambda c: F.coalesce(1.0 / (FUSION + F.col(c)), F.lit(0.0))
    return both.select("id", F.round(part("exact_rank") + part("semantic_rank"), 9).alias("score"), "exact_rank", "semantic_rank")


def hybrid(ev: DataFrame, tokens: list[str], query: list[float] | None, start=None, end=None, limit: int = 50, offset: int = 0) -> DataFrame:
    """Fused hits with their events. The at most 2 * BRANCH candidates are broadcast to the events, whose texts stay in place."""
    exact = exact_branch(ev.drop("embedding"), tokens, start, end)
    if query is None:
        semantic = exact.select("id", F.lit(None).cast("int").alias("semantic_rank")).limit(0)
    else:
        semantic = vector_top(ev, query, start, end)
    fused = F.broadcast(fuse(exact, semantic))
    hits = ev.drop("embedding").join(fused, "id").withColumn("excerpt", excerpt(F.col("ocr_text")))
    return hits.select(*HIT).orderBy(F.desc("score"), "started_at", "id").offset(offset).limit(clamp(limit))


def page(hits: DataFrame, limit: int, offset: int = 0) -> tuple[DataFrame, bool, int | None]:
    """A page of ordered hits, whether there are more, and the next offset."""
    more = hits.offset(offset).limit(limit + 1).count() > limit
    return hits.offset(offset).limit(limit), more, offset + limit if more else None


def neighbours(ev: DataFrame, event_id: int, n: int = 2) -> DataFrame:
    """The n events before and after one, across sessions; events of the very same time are neither."""
    one = ev.filter(F.col("id") == event_id).select("started_at").first()
    if one is None:
        return ev.limit(0).withColumn("side", F.lit(""))
    at = F.lit(one[0].isoformat(sep=" ")).cast("timestamp_ntz")
    before = ev.filter(F.col("started_at") < at).orderBy(F.desc("started_at"), F.desc("id")).limit(n).withColumn("side", F.lit("before"))
    after = ev.filter(F.col("started_at") > at).orderBy("started_at", "id").limit(n).withColumn("side", F.lit("after"))
    return before.unionByName(after)


def with_previous(ev: DataFrame) -> DataFrame:
    """Events (id, session_id, started_at) with the id of the session's previous event."""
    return beside(ev, "session_id", "started_at", "id", {"previous_id": lambda w: F.lag("id").over(w)}).drop("nth")


def with_neighbours(ev: DataFrame, n: int = 2) -> DataFrame:
    """Events with the ids of the n before and the n after them in their session."""
    around = lambda a, b: lambda w: F.collect_list("id").over(w.rowsBetween(a, b))
    return beside(ev, "session_id", "started_at", "id", {"before_ids": around(-n, -1), "after_ids": around(1, n)}, before=n, after=n).drop("nth")


def holding_tokens(ev: DataFrame, tokens: list[str]) -> DataFrame:
    """(token, n_events, first_event) of the tokens that some event's text holds, in any case, from one scan for all of them.

    A task searches its texts for all tokens at once by an automaton and adds up its own counts; callers bound the list.
    """
    import pyarrow as pa

    wanted = sorted({t.lower() for t in tokens if t})

    def run(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, t in enumerate(wanted):
            automaton.add_word(t, i)
        automaton.make_automaton()
        n, first = [0] * len(wanted), [None] * len(wanted)
        for batch in batches:
            for event, low in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for i in {i for _, i in automaton.iter(low)} if low else ():
                    n[i] += 1
                    first[i] = event if first[i] is None or (event is not None and event < first[i]) else first[i]
        found = [i for i, k in enumerate(n) if k]
        yield pa.RecordBatch.from_arrays([pa.array([wanted[i] for i in found], pa.string()), pa.array([n[i] for i in found], pa.int64()), pa.array([first[i] for i in found], pa.int64())], ["token", "n", "first"])

    if not wanted:
        return ev.select(F.lit("").alias("token"), F.lit(0).cast("long").alias("n_events"), F.col("id").alias("first_event")).limit(0)
    parts = ev.select(F.col("id").cast("long"), F.lower("ocr_text")).mapInArrow(run, "token string, n long, first long")
    return parts.groupBy("token").agg(F.sum("n").alias("n_events"), F.min("first").alias("first_event"))


def wildcard(text: Column, pattern: str, escaped: bool = False) -> Column:
    """LIKE over any case; % and _ of the input act as wildcards unless escaped."""
    p = F.lit(f"%{pattern}%")
    return F.ilike(text, F.concat(F.lit("%"), escape_like(F.lit(pattern)), F.lit("%"))) if escaped else F.ilike(text, p)
