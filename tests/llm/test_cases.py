"""Rows that share a doc_id or have none, long texts, and results recomputed from the definitions."""

import hashlib
import html
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
from conftest import DATA
from pyspark.sql import functions as F

from tidemark.llm import common, fingerprints, html_extraction, language_id, minhash_dedup, pii, suffix_dedup, textops

CLASHING = [(None, "m" * 400), (None, "q" * 130 + "m" * 200), (None, "x"), (None, "m" * 400), (7, "m" * 120), (7, "other"), (7, "zz" + "m" * 150), (3, None), (3, ""), (5, "q" * 140)]


def signed(spark, rows):
    """Rows with the 64-bit hash that orders texts of one doc_id."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, doc_id long, text string")
    signs = {r["i"]: r["s"] for r in df.select("i", F.xxhash64(F.coalesce("text", F.lit(""))).alias("s")).collect()}
    return [(*r, signs[i]) for i, r in enumerate(rows)]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2]))


# document keys -----------------------------------------------------------------------------------------------------


def test_document_keys(spark):
    rows = signed(spark, CLASHING)
    df = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    got = common.document_keys(df, F.coalesce("doc_id", F.lit(-1)), "key").collect()
    want = {(d, s): i for i, (d, s) in enumerate(dict.fromkeys((r[0], r[2]) for r in in_order(rows)))}
    ranks = sorted({r["key"] for r in got})
    sign = {(r[0], r[1] or ""): r[2] for r in rows}
    assert len(got) == len(rows) and all(ranks.index(r["key"]) == want[r["doc_id"], sign[r["doc_id"], r["text"] or ""]] for r in got)
    one = spark.createDataFrame([(4, "a"), (4, "a"), (2, None)], "doc_id long, text string")
    assert sorted(r["key"] for r in common.document_keys(one, F.col("doc_id"), "key").collect()) == [2, 4, 4]


# 1 -----------------------------------------------------------------------------------------------------------------


def article_of(page):
    """The article of one of the driver's pages by cutting its markup."""
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = [" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(b for b in blocks if b)


def test_html_pages_equal_their_articles(spark):
    pages = spark.read.parquet(str(DATA / "sf0.01" / "pages.parquet"))
    got = html_extraction.extracted(pages.withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))).collect()
    want = {r["page_id"]: article_of(r["html"]) for r in pages.collect()}
    assert len(got) == len(want) and all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)


PLAIN = """<body><div><a href=1>Home</a></div><div><a href=2>World news</a></div><div>Buy new shoes today</div><div><a href=3>Sport</a></div>
<h2>How rivers find their way to the sea</h2><div>{0}</div><div>A short one.</div><div>{0} with <a href=4>one link</a> in it</div>
<div><a href=5>More of this</a></div><div><a href=6>Other things to read</a></div><div>Copyright of the paper</div></body>"""
LONG = "Many words of a paragraph that goes on about rivers and hills and towns, as long texts do, with few links in it"


def test_html_without_article_or_names():
    """Words and links of a block and its neighbours decide where nothing is named."""
    tree = html_extraction.grow(html_extraction.table())
    assert html_extraction.main_text(PLAIN.format(LONG), tree) == f"How rivers find their way to the sea\n\n{LONG}\n\nA short one.\n\n{LONG} with one link in it"


def test_html_names_inside_an_article_drop_nothing():
    tree = html_extraction.grow(html_extraction.table())
    page = '<article><h1>Old notices</h1><p class="notice">A long paragraph of the article about notices.</p><p class="social-history">Another one.</p><form><p>{0}</p><p>{0}</p></form><div class="comments"><p>{0}</p></div></article>'
    assert html_extraction.main_text(page.format(LONG), tree) == f"Old notices\n\nA long paragraph of the article about notices.\n\nAnother one.\n\n{LONG}\n\n{LONG}"


def test_html_decisions_are_no_single_figure(spark):
    """On the driver's pages, on these without names, and on small ones no figure alone decides; neighbours' figures do change decisions."""
    tree = html_extraction.grow(html_extraction.table())
    pages = [r["html"] for r in spark.read.parquet(str(DATA / "sf0.01" / "pages.parquet")).collect()]
    bare = [re.sub(r"<(/?)(nav|footer|article|ul|li)\b", r"<\1div", p).replace(' class="ad"', "") for p in pages]
    for some in (pages, [*bare, PLAIN.format(LONG)]):
        rows = [x for p in some for x in html_extraction.figures(html_extraction.read(p).blocks)]
        decided = [html_extraction.decide(tree, x) for x in rows]
        for f in range(len(rows[0])):
            for limit in {x[f] for x in rows}:
                same = sum((x[f] <= limit) == bool(d) for x, d in zip(rows, decided))
                assert 0 < same < len(rows)
        alone = [html_extraction.decide(tree, [*x[:2], 0, 0.0, 0, 0.0, *x[6:]]) for x in rows]
        mixed = [html_extraction.decide(tree, [*x[:2], *y[2:6], *x[6:]]) for x, y in zip(rows, rows[7:] + rows[:7])]
        assert some is pages or (alone != decided and mixed != decided)
    right = [bool(html_extraction.decide(tree, x)) == (t in article_of(p).split("\n\n")) for p, b in zip(pages, bare) for r in [html_extraction.read(b)] for t, x in zip(r.texts, html_extraction.figures(r.blocks))]
    assert sum(right) > 0.92 * len(right)


def test_html_long_page():
    tree = html_extraction.grow(html_extraction.table())
    page = "<article>" + "<p>Some &lt;words&gt; of a <b>paragraph</b>\tthat is not long</p>" * 30_000 + "</article>"
    got = html_extraction.main_text(page, tree).split("\n\n")
    assert len(got) == 30_000 and set(got) == {"Some <words> of a paragraph that is not long"}


# 2 -----------------------------------------------------------------------------------------------------------------


def test_deduplicated_tells_texts_of_one_id_apart(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(40)) for x in "ab")
    rows = [(1, a, 0), (1, b, 1), (1, b, 2), (2, a + " end", 3), (None, b + " end", 4), (None, "quite another text", 5), (None, None, 6)]
    got = minhash_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string, __sign int"))
    assert got.columns == ["doc_id", "text", "__sign"]
    kept = got.collect()
    assert sorted((r["doc_id"], r["text"]) for r in kept if r["doc_id"]) == [(1, a), (1, b)]
    assert sorted(r["text"] or "" for r in kept if not r["doc_id"]) == ["", "quite another text"]


def test_words_of_long_texts_in_parts(monkeypatch):
    random.seed(2)
    texts = ["".join(random.choice(["ab", " ", "c", "\n", "é"]) for _ in range(k)) for k in (0, 900, 3, 2000, 0, 41)] + ["x" * 700]
    data, starts = textops.utf8(pa.array(texts))
    whole = textops.word_hashes(data, starts)
    monkeypatch.setattr(textops, "SLICE", 64)
    parts = textops.word_hashes(data, starts)
    assert len(whole[0]) > 300 and all((a == b).all() for a, b in zip(whole, parts))


# 3 -----------------------------------------------------------------------------------------------------------------


def test_every_language_is_learned(spark):
    """More languages than a sample of a few rows each would hold: all can be predicted."""
    alphabets = ["".join(chr(0x3400 + 20 * k + i) for i in range(20)) for k in range(230)]
    random.seed(8)
    rows = [(n * 230 + k, "".join(random.choice(a) for _ in range(30)), f"l{k:03}") for k, a in enumerate(alphabets) for n in range(9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = language_id.language_of_documents(df).join(df.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len({r["lang_pred"] for r in got}) > 225 and sum(r["lang"] == r["lang_pred"] for r in held) > 0.9 * len(held)


def test_scores_are_the_model(spark):
    """Predictions recomputed in plain Python from the learned weights."""
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr")] * 12)] + [(900, "1 2 3", "en"), (901, None, "de"), (902, "Die " * 5000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("__lid_lang", F.lit("clash")).withColumn("score", F.lit(2))
    langs, weights, idf, temperature = model = language_id.learn(df)
    for r in language_id.predict(df.drop("__lid_lang"), model, keep=["doc_id", "text"]).collect():
        letters = "".join(c if c.isalpha() else " " for c in (r["text"] or "").lower())
        if not letters.strip():
            assert (r["__lid_lang"], r["__lid_score"]) == ("und", 0.0)
            continue
        n = language_id.counts(r["text"])
        x = {b: (1 + np.log(c)) * idf[b] for b, c in enumerate(n) if c}
        norm = np.sqrt(sum(v * v for v in x.values()))
        logits = [(sum(float(weights[k][b]) * v / norm for b, v in x.items()) + float(weights[k][-1])) / temperature for k in range(len(langs))]
        p = np.exp(np.array(logits) - max(logits))
        p /= p.sum()
        assert r["__lid_lang"] == langs[int(p.argmax())] and r["__lid_score"] == pytest.approx(float(p.max()), rel=1e-4)
    kept = language_id.filtered(df)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()}.isdisjoint({900, 901})
    assert language_id.filtered(df.limit(0)).count() == 0


# 5 -----------------------------------------------------------------------------------------------------------------


def hashes_of(spark, texts):
    """text -> the hashes of its shingles, by Spark's hash of the words."""
    every = {}
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        every[t] = [" ".join(w)] if 0 < len(w) < 5 else [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    fives = sorted({s for v in every.values() for s in v if isinstance(s, tuple)})
    ones = sorted({s for v in every.values() for s in v if isinstance(s, str)})
    found = {}
    if fives:
        df = spark.createDataFrame(fives, "a string, b string, c string, d string, e string")
        found |= {tuple(r)[:5]: r["h"] for r in df.withColumn("h", F.xxhash64("a", "b", "c", "d", "e")).collect()}
    if ones:
        found |= {r["a"]: r["h"] for r in spark.createDataFrame([(o,) for o in ones], "a string").withColumn("h", F.xxhash64("a")).collect()}
    return {t: {found[s] for s in v} for t, v in every.items()}


def kept_of(hashes):
    low = {h for h in hashes if h < -(1 << 63) + (1 << 62)}
    return low or ({min(hashes)} if hashes else set())


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def check_fingerprints(spark, rows, got):
    order = in_order(signed(spark, rows))
    plan = []
    for i, (d, t, _) in enumerate(order):
        t, after = t or "", order[(i + 1) % len(order)][1] or ""
        half = len(t) // 2
        plan.append((d, t, t[: len(t) - half] + after[:half], after))
    sketch = {t: kept_of(h) for t, h in hashes_of(spark, {x for p in plan for x in p[1:]}).items()}
    text = lambda t: "".join(f"{(h + (1 << 63)) >> 16:012X}" for h in sorted(sketch[t]))
    want = [(d, len(t), hashlib.sha256(e.encode()).hexdigest(), text(t), text(e), round(jaccard(sketch[t], sketch[e]), 9), round(jaccard(sketch[t], sketch[a]), 9)) for d, t, e, a in plan]
    have = [(r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got]
    assert sorted(have, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_fingerprints_recomputed(spark, monkeypatch, broadcast):
    monkeypatch.setattr(fingerprints, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 40)
    monkeypatch.setattr(fingerprints, "BUCKETS", 3)
    monkeypatch.setattr(fingerprints, "BLOCK", 2)
    random.seed(9)
    some = [" ".join(random.choice("abcdefgh") * random.randrange(1, 4) for _ in range(random.randrange(60))) for _ in range(30)]
    rows = [(i * 7 - 300, random.choice(some)) for i in range(300)] + [(None, "the same")] * 150 + [(5000, t) for t in some[:9]] + [(None, None), (2, "a b c d " * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("x")).withColumn("bucket", F.lit(1))
    check_fingerprints(spark, rows, fingerprints.fingerprints(df).collect())


def test_fingerprints_of_hot_copies_without_other_texts(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", 40)
    rows = [(None, "same text of all")] * 300 + [(i, f"text {i} of one") for i in range(100)]
    check_fingerprints(spark, rows, fingerprints.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect())


# 6 -----------------------------------------------------------------------------------------------------------------


def disclosing(rows, threshold=0.9, level=0.05):
    """(value, term) pairs by counting, from short texts with at most one email each."""
    email = re.compile(r"[\w.]+@[\w.]+\w")
    word = lambda t: set(regex.findall(r"[\p{L}\p{N}]+", t.lower()))
    texts = [t or "" for _, t in rows]
    n_t, n_c, n_tc, contexts, tested = Counter(), Counter(), Counter(), {}, 0
    for t in texts:
        n_t.update(word(t))
        if found := email.search(t):
            c, left = found.group().lower(), t[: found.start()] + " " + t[found.end() :]
            terms = word(left) & word(t)
            tested += len(terms)
            n_c[c] += 1
            for x in terms | {None}:
                n_tc[c, x] += 1
                contexts.setdefault((c, x), set()).add(left)
    n, out = len(texts), set()
    for (c, x), own in contexts.items():
        if x is not None:
            d, k, b = len(contexts[c, None]), len(own), n_t[x] / n
            a = k / d
            divergence = a * math.log(a / b) + ((1 - a) * math.log((1 - a) / (1 - b)) if a < 1 else 0)
            ic, pmi = math.log2(n / n_c[c]), math.log2(n_tc[c, x] * n / (n_t[x] * n_c[c]))
            if a > b and ic > 0 and pmi >= threshold * ic and math.log(max(1, tested)) - d * divergence <= math.log(level):
                out.add(("email:" + c, x))
    return out


@pytest.mark.parametrize("broadcast", [0, 10**6])
def test_disclosing_terms_recomputed(spark, monkeypatch, broadcast):
    monkeypatch.setattr(pii, "BROADCAST_TERMS", broadcast)
    monkeypatch.setattr(pii, "BROADCAST_DOCS", broadcast)
    random.seed(12)
    names, rows = ["Zorbulon", "Quibble", "Ärger", "smith.x"], []
    for i in range(500):
        k = random.randrange(40)
        said = " ".join(random.choice(["call", "write", "soon", "day", f"n{random.randrange(60)}"]) for _ in range(5))
        mail = f" mail {'abcd'[k]}@x{k}.org" if k < 4 and random.random() < 0.7 else ""
        rows.append((None if i % 50 == 7 else i % 450, f"{said} {names[k] if k < 4 else 'who'}{mail}" if i % 41 else None))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"sign": F.lit("x"), "__pii_text": F.lit(1), "base": F.lit(2), "a.b": F.lit(3)})
    want = disclosing(rows)
    assert want and {(r["entity"], r["term"]) for r in pii.disclosing_terms(df).collect()} == want
    terms = {t for _, t in want}
    spans = lambda t: [(m.start(), m.end()) for m in regex.finditer(r"[\p{L}\p{N}]+", t or "") if m.group().lower() in terms]
    got = pii.personal_data(df).collect()
    added = sorted((r["doc_id"] or -1, sorted(tuple(map(int, s.split(":")[1:])) for s in r["spans"].split(",") if s.startswith("term"))) for r in got)
    assert added == sorted((d or -1, spans(t)) for d, t in rows)
    clean = pii.sanitised(df)
    assert clean.columns == df.columns
    for r in clean.collect():
        assert r["text"] is None or not (terms & set(regex.findall(r"[\p{L}\p{N}]+", r["text"].lower()))) and "@" not in r["text"]
    assert pii.sanitised(df.limit(0)).count() == 0 and pii.personal_data(df.limit(0)).count() == 0


# 9 -----------------------------------------------------------------------------------------------------------------


def repeats(rows, n=100):
    seen, out = {}, []
    for d, t, sign in in_order(rows):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if seen.setdefault(b[p : p + n], (d, sign, p)) != (d, sign, p):
                gone[p : p + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeats_removed(df).collect()), key=repr)


@pytest.mark.parametrize("part", [1 << 19, 256])
def test_repeats_of_shared_ids_and_long_texts(spark, monkeypatch, part):
    """Texts that share an id are documents of their own; a long text in parts gives what it gives as a whole."""
    monkeypatch.setattr(suffix_dedup, "SLICE", part)
    monkeypatch.setattr(suffix_dedup, "HOT", 30)
    random.seed(6)
    piece = ["".join(random.choice("abc dé") for _ in range(300)) for _ in range(4)]
    rows = CLASHING + [(9, "".join(random.choice(piece) for _ in range(12))), (None, piece[0] + piece[1] * 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"doc": F.lit(1), "removed": F.lit("x"), "spans": F.lit(2)}).repartition(3)
    got = removed(df)
    assert got == repeats(signed(spark, rows)) and all(r[2] <= r[1] for r in got)
