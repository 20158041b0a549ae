"""Personal data: patterns find base spans, and corpus co-occurrence finds terms that disclose them.

Base kinds are email, ip, card and phone. Beyond them the method is information-theoretic sanitisation: a protected
entity c is a value of base kind; the terms t are the words of the documents that hold it, outside their base spans.
Over all documents, PMI(t; c) = log2(n(t, c) N / (n(t) n(c))) is the information that t gives about c, and
IC(c) = log2(N / n(c)) all there is. A term that discloses THRESHOLD or more of it, and is with c more often than chance
explains, becomes a span of kind `term` wherever it occurs, also in documents that don't hold c. Chance is tested for every pair, however rare:
of the d different contexts of c (its document's first text within WINDOW code points, by hash) k are with t, which by
chance has at most the probability exp(-d KL(k/d || n(t)/N)), Chernoff's bound of the hypergeometric tail. Times the
number of pairs in all documents (Bonferroni) it must be LEVEL or less. sanitised() generalises base spans to their kind and removes terms.

Null or empty text: no spans. Null doc_id: as any other. Repeated rows: the same result for each, and one context, so
copies alone never make a term significant. Rows that share a doc_id get the spans of their own text. Empty tables give
empty results. Whole texts of any length are searched; patterns take linear time and no stack. Other columns, of any
name, stay in sanitised() and are ignored elsewhere. Matches never overlap within a kind; kinds may overlap, and
sanitised() puts the label of the one that begins first, of ties the longest. Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from .common import guarded, materialise, settle

WINDOW, THRESHOLD, LEVEL = 80, 0.9, 0.05
#: Candidate terms up to this many are sent to all executors (some MB), more are joined by a shuffle.
BROADCAST_TERMS = 100_000
#: So with documents that hold disclosing terms, whose other texts then stay in place.
BROADCAST_DOCS = 20_000
# The base patterns. Quantifiers are possessive, and a match starts a run or follows a match, so that
# the same matches take linear time and no stack.
_WORD = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_WORD})|\G){_WORD}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must match to be searched for a kind at all.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": r"\+[0-9]"}
SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"
TERM = r"[\p{L}\p{N}]+"


def _let(value: Column, body) -> Column:
    return F.transform(F.array(value), body).getItem(0)


def matches(text: Column, pattern: Column, kind: str) -> Column:
    """Leftmost matches with code point offsets: what lies between them has the lengths that their places add up from."""
    step = "struct<at:int,spans:" + SPAN + ">"

    def places(hits: Column) -> Column:
        gaps = F.transform(F.slice(F.split(text, pattern, -1), 1, F.size(hits)), lambda g: F.length(g))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans")).cast(step)

        def add(acc: Column, x: Column) -> Column:
            begin = acc["at"] + x["gap"]
            end = begin + F.length(x["hit"])
            one = F.struct(F.lit(kind).alias("kind"), begin.alias("start"), end.alias("end"), x["hit"].alias("value"))
            return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(one)).alias("spans")).cast(step)

        pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.aggregate(pairs, start, add)["spans"]

    return _let(F.regexp_extract_all(text, pattern, F.lit(0)), lambda hits: F.when(F.size(hits) > 0, places(hits)).otherwise(F.array().cast(SPAN)))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(F.reverse(digits), i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: _let(F.regexp_replace(p, "^0+", ""), lambda x: (F.length(x) < 3) | ((F.length(x) == 3) & (x <= "255"))))
    if kind == "card":
        return _let(_digits(value), lambda d: F.when(F.length(d).between(16, 19), _luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def _test(kind: str):
    return lambda span: _holds(kind, span["value"])


def base_spans(docs: DataFrame, text: str = "__pii_text", out: str = "__pii_base") -> DataFrame:
    """docs with an array of base spans, by kind as listed, then start."""
    kinds = {}
    for kind, pattern in PATTERNS.items():
        found = F.filter(matches(F.col(text), F.lit(pattern), kind), _test(kind))
        hint = F.col(text).contains("@") if kind == "email" else F.col(text).rlike(HINTS[kind])
        kinds[f"{out}_{kind}"] = F.when(hint, found).otherwise(F.array().cast(SPAN))
    return docs.withColumns(kinds).withColumn(out, F.concat(*[F.col(k) for k in kinds])).drop(*kinds)


def _entity(span: Column) -> Column:
    """A value in one spelling: an email in lower case, others as their digits and dots."""
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"] == "email", F.lower(span["value"])).when(span["kind"] == "ip", span["value"]).otherwise(_digits(span["value"])))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.withColumn("__pii_text", F.coalesce(F.col("text").cast("string"), F.lit("")))


def disclosing_terms(docs: DataFrame, window: int = WINDOW, threshold: float = THRESHOLD, level: float = LEVEL) -> DataFrame:
    """(entity, term) where the term discloses the entity, as a table."""
    return settle("pii-disclosing", lambda: _disclosing_terms(docs, _rows(docs, window), threshold, level))


def _rows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """A table of a row for each of docs, from one scan: doc_id, sign of the text, base spans, and with spans entities and terms.

    entities: the values of the row, each with the least of its contexts there, so that a row is one context of a value
    at most. terms: the words outside of spans; a word that a span cuts is none of the text's own.
    """
    d = base_spans(_texts(docs.select("doc_id", "text")))
    text, spans = F.col("__pii_text"), F.col("__pii_base")
    near = F.array_sort(F.transform(spans, lambda s: F.struct(_entity(s).alias("entity"), _context(text, s, window).alias("context"))))
    first = _let(near, lambda x: F.filter(x, lambda e, i: (i == 0) | (F.get(x, i - 1)["entity"] != e["entity"])))
    terms = F.array_intersect(_terms(_outside(text, spans)), _terms(text))
    some = F.size(spans) > 0
    places = F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return materialise(d.select("doc_id", F.xxhash64(text).alias("sign"), places.alias("base"), F.when(some, first).alias("entities"), F.when(some, terms).alias("terms")), "pii-rows")


def _context(text: Column, s: Column, window: int) -> Column:
    left = F.substring(text, F.greatest(s["start"] - window + 1, F.lit(1)), F.least(s["start"], F.lit(window)))
    right = F.substring(text, s["end"] + 1, F.lit(window))
    # A word cut by the window's edge doesn't count.
    left = F.when(s["start"] > window, F.regexp_replace(left, r"^\S+", "")).otherwise(left)
    right = F.when(F.length(right) == window, F.regexp_replace(right, r"\S+$", "")).otherwise(right)
    return F.xxhash64(F.concat(left, F.lit(" "), right))


def _outside(text: Column, spans: Column) -> Column:
    """The text with a space in place of each span."""
    step = "struct<at:int,parts:array<string>>"

    def add(acc: Column, s: Column) -> Column:
        between = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["parts"], F.array(between)).alias("parts")).cast(step)

    by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts")).cast(step)
    return _let(F.aggregate(by_place, start, add), lambda a: F.concat(F.array_join(a["parts"], " "), F.lit(" "), F.substring(text, a["at"] + 1, F.length(text))))


def _disclosing_terms(docs: DataFrame, rows: DataFrame, threshold: float, level: float) -> DataFrame:
    seen = rows.filter(F.col("entities").isNotNull()).select("entities", "terms")
    every = _texts(docs.select("text"))
    n, tested = float(rows.count()), seen.agg(F.sum(F.size("entities") * F.size("terms"))).first()[0] or 1
    n_c = seen.select(F.explode("entities").alias("e")).select("e.*").groupBy("entity").agg(F.count(F.lit(1)).alias("n_c"), F.count_distinct("context").alias("d"))
    # Chance explains a single context with a probability of 1 / N at least: where that is too much, its terms need no count.
    n_c = materialise(n_c.filter(F.col("d") >= (2 if tested > level * n else 1)), "pii-entities")
    held = seen.select(F.explode("entities").alias("e"), "terms").select("e.entity", "e.context", "terms")
    held = held.join(F.broadcast(n_c) if n_c.count() <= BROADCAST_TERMS else n_c, "entity")
    pairs = held.select("entity", "n_c", "d", "context", F.explode("terms").alias("term")).groupBy("entity", "n_c", "d", "term", "context").agg(F.count(F.lit(1)).alias("n"))
    pairs = pairs.groupBy("entity", "n_c", "d", "term").agg(F.sum("n").alias("n_tc"), F.count(F.lit(1)).alias("k"))

    def significant(n_t: Column) -> Column:
        a, b = F.col("k") / F.col("d"), n_t / n
        rest = F.when(F.col("k") < F.col("d"), (1 - a) * F.log((1 - a) / (1 - b))).otherwise(0.0)
        return (a > b) & (F.log(F.lit(float(tested))) - F.col("d") * (a * F.log(a / b) + rest) <= math.log(level))

    # A term is in n_tc documents at least: what isn't significant even so needs no count.
    pairs = materialise(pairs.filter(significant(F.col("n_tc"))), "pii-pairs")
    wanted = pairs.select("term").distinct()
    if not (n_terms := wanted.count()):
        return pairs.select("entity", "term")
    if n_terms <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    n_t = every.select(F.explode(_terms(F.col("__pii_text"))).alias("term")).join(wanted, "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    ic = F.log2(F.lit(n) / F.col("n_c"))
    pmi = F.log2(F.col("n_tc") * n / (F.col("n_t") * F.col("n_c")))
    return pairs.join(n_t, "term").filter((ic > 0) & (pmi >= threshold * ic) & significant(F.col("n_t"))).select("entity", "term")


def _patterns(docs: DataFrame, disclosing: DataFrame) -> DataFrame:
    """(__pii_doc, __pii_sign, __pii_pattern) of the documents that hold disclosing terms, as a table: the pattern finds a document's own."""
    terms = disclosing.select("term").distinct()
    if terms.count() <= BROADCAST_TERMS:
        terms = F.broadcast(terms)
    d = _texts(docs.select("doc_id", "text"))
    own = d.select("doc_id", F.xxhash64("__pii_text").alias("sign"), F.explode(_terms(F.col("__pii_text"))).alias("term")).join(terms, "term")
    held = own.groupBy("doc_id", "sign").agg(F.sort_array(F.collect_set("term"), asc=False).alias("terms"))
    either = F.array_join(F.transform("terms", lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E"))), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), either, F.lit(r")(?![\p{L}\p{N}])"))
    return materialise(held.select(F.col("doc_id").alias("__pii_doc"), F.col("sign").alias("__pii_sign"), pattern.alias("__pii_pattern")), "pii-patterns")


def _with_patterns(docs: DataFrame, rows: DataFrame) -> DataFrame | None:
    """docs with __pii_text that hold disclosing terms, with their pattern; None if no term discloses anything."""
    disclosing = settle("pii-disclosing", lambda: _disclosing_terms(docs, rows, THRESHOLD, LEVEL))
    if disclosing.isEmpty():
        return None
    patterns = _patterns(docs, disclosing)
    return F.broadcast(patterns) if patterns.count() <= BROADCAST_DOCS else patterns


def _joined(d: DataFrame, patterns: DataFrame, how: str) -> DataFrame:
    """d (doc_id, __pii_text) with the pattern of its own text, so that rows which share an id get the places in theirs."""
    return d.join(patterns, F.col("doc_id").eqNullSafe(F.col("__pii_doc")) & (F.xxhash64("__pii_text") == F.col("__pii_sign")), how)


def _term_spans(pattern: str = "__pii_pattern") -> Column:
    return F.when(F.col(pattern).isNotNull(), matches(F.col("__pii_text"), F.col(pattern), "term")).otherwise(F.array().cast(SPAN))


def _written(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of each document, as a table. Only texts with terms are joined."""
    return settle("pii-result", lambda: _personal_data(docs.select("doc_id", "text")))


def _personal_data(docs: DataFrame) -> DataFrame:
    rows = _rows(docs)
    patterns = _with_patterns(docs, rows)
    out, added = rows.select("doc_id", "sign", "base"), F.lit("")
    if patterns is not None:
        found = _joined(_texts(docs), patterns, "inner").select("__pii_doc", "__pii_sign", _written(_term_spans()).alias("added")).distinct()
        found = materialise(found, "pii-added")
        found = F.broadcast(found) if found.count() <= BROADCAST_DOCS else found
        out = out.join(found, F.col("doc_id").eqNullSafe(F.col("__pii_doc")) & (F.col("sign") == F.col("__pii_sign")), "left")
        added = F.coalesce(F.col("added"), F.lit(""))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    out = out.select("doc_id", *[count(k) for k in PATTERNS], _written(F.col("base")).alias("base"), added.alias("added"))
    joined = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("added") != "", F.col("added")))
    return out.select("doc_id", *[f"n_{k}" for k in PATTERNS], F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"), joined.alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """docs with base spans generalised to [EMAIL], [IP], [CARD] or [PHONE] and disclosing terms removed; all columns stay."""
    return guarded(docs, _sanitised)


def _sanitised(docs: DataFrame) -> DataFrame:
    patterns = _with_patterns(docs, _rows(docs))
    d = base_spans(_texts(docs))
    spans = F.col("__pii_base")
    if patterns is not None:
        d = _joined(d, patterns, "left")
        spans = F.concat(spans, _term_spans())
    d = d.withColumn("__pii_spans", spans)
    t = F.col("__pii_text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast("struct<at:int,out:string>")

    def put(acc: Column, s: Column) -> Column:
        between = F.substring(t, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        label = F.when((s["start"] < acc["at"]) | (s["kind"] == "term"), "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], between, label).alias("out")).cast("struct<at:int,out:string>")

    by_place = F.array_sort(F.transform("__pii_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"), s["end"].alias("end"))))
    put_in = _let(F.aggregate(by_place, start, put), lambda a: F.concat(a["out"], F.substring(t, a["at"] + 1, F.length(t))))
    text = F.when(F.size("__pii_spans") > 0, put_in).otherwise(F.col("text"))
    return d.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])
