"""Each operator against a brute-force version on small fixtures: nulls, empty and long texts, ties, repeated rows, empty tables."""

import hashlib
import json
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tidemark.llm import common, components, embedding_dedup, fingerprints, html_extraction, language_id, lm_scoring, minhash_dedup, mixing, packing, pii, queries, suffix_dedup, textops

SF = DATA / "sf0.001"
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (None, "x y z"), (3, "x y z"), (3, "X Y  z"), (5, "a"), (6, "A"), (7, "a b " * 3000), (8, "b a " * 3000), (9, " \t\n"), (10, "é ü\x1cß 漢字 \U0001f600")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(str(SF / "documents.parquet"))


@pytest.fixture(scope="module")
def odd(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    rows = [(*r, "en", None, 7, [1], "x") for r in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n long, spans array<int>, component string")


def words(text):
    return WORD.findall((text or "").translate(SMALL))


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_every_operator_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    sf = DATA / "sf0.01"
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    df = queries.QUERIES[name](spark, str(sf))
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want)


def test_settled_results_leave_no_scratch_tables(spark):
    from pathlib import Path

    folder = Path(common.shared_dir(spark).removeprefix("file://")) / "tidemark" / spark.sparkContext.applicationId
    before = set(folder.iterdir()) if folder.exists() else set()

    def build():
        a = common.settle("inner", lambda: common.materialise(spark.range(10), "one").filter("id > 2"))
        return common.materialise(a, "two").filter("id > 5")

    rows = spark.conf.get(common.ARROW_ROWS)
    out = common.settle("outer", lambda: (common.small_batches(spark, 7), build())[1])
    assert out.count() == 4 and spark.conf.get(common.ARROW_ROWS) == rows
    assert [p.name.split("-")[0] for p in set(folder.iterdir()) - before] == ["outer"]


def test_threads_settle_apart(spark):
    """A table of one thread isn't deleted by a query of another."""
    from concurrent.futures import ThreadPoolExecutor

    def query(k):
        return common.settle("t", lambda: common.materialise(spark.range(k), "own").filter("id >= 0")).count()

    with ThreadPoolExecutor(4) as pool:
        assert list(pool.map(query, range(1, 9))) == list(range(1, 9))


def test_shared_folder_must_be_named_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="checkpoint"):
        common.shared_dir(Session())


# 1 ---------------------------------------------------------------------------------------------------------------

PAGE = """<html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=/>Home</a></li></ul></nav>
<div class="cookie-notice">We use cookies, and these are many words about them, so many that they look like text.</div>
<article><h1>A title &amp; more</h1><p>First  <b>paragraph</b>
of the article.<p>Second&nbsp;one, with a <a href=x>link</a> in it.<br>On a new line.<script>if (a < b) document.write("<p>no</p>")</script></p><!-- <p>no</p> -->
<section class="comments"><article class="comment"><p>A reader says many words here, which are long enough to look like the text of an article.</p></article></section>
<aside><p>Related words of an aside.</p></aside></article><form><label>Name</label><input></form><footer>&copy; 2020</footer></body></html>"""


def test_html_page():
    tree = html_extraction.grow(html_extraction.table())
    assert html_extraction.main_text(PAGE, tree) == "A title & more\n\nFirst paragraph of the article.\n\nSecond one, with a link in it. On a new line."


def test_html_tree_fits_its_table():
    rows = html_extraction.table()
    tree = html_extraction.grow(rows)
    assert len(rows) < 200 and sum(html_extraction.decide(tree, x) == y for x, y in rows) >= 0.98 * len(rows)


@pytest.mark.parametrize("page", [None, "", "<", "<p", '<a "', "<script>x", "<!-- x", "</p></div>", "<" * 5000, "<p>" * 5000, '<a b="' * 2000])
def test_html_odd_pages(page):
    assert isinstance(html_extraction.main_text(page, html_extraction.grow(html_extraction.table())), str)


def test_html_query(spark):
    pages = spark.read.parquet(str(SF / "pages.parquet"))
    got = html_extraction.extracted(pages).collect()
    assert len(got) == pages.count() and all(r["n_chars"] == len(r["text"]) > 0 for r in got)
    assert not any("track(" in r["text"] or "<p>" in r["text"] for r in got)
    e = spark.createDataFrame([(1, None, None), (None, "u", "<article><p>text</p></article>"), (1, None, None)], "page_id long, url string, html string")
    assert sorted(r["text"] for r in html_extraction.extracted(e).collect()) == ["", "", "text"]
    assert html_extraction.extracted(e.limit(0)).count() == 0


# 2 ---------------------------------------------------------------------------------------------------------------


def groups(rows, k=2, percent=80):
    """doc -> (set size, component) by comparing all pairs."""
    sets = []
    for _, t in rows:
        w = words(t)
        sets.append({tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            shared = len(a & b)
            if a and b and 100 * shared >= percent * (len(a) + len(b) - shared):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def near(spark, df, **kw):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in minhash_dedup.near_groups(df, **kw).collect()), key=repr)


def test_near_groups_equal_brute_force(spark, docs, odd):
    assert near(spark, docs) == groups(pairs(docs))
    assert near(spark, odd.select("doc_id", "text")) == groups(ODD)
    assert minhash_dedup.near_groups(odd.limit(0)).count() == 0


def test_near_groups_of_many_near_copies(spark, monkeypatch):
    """A group around the threshold, through table branching and blocks."""
    random.seed(3)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for d in range(300):
        w = list(base)
        for _ in range(random.randrange(6)):
            w[random.randrange(60)] = f"x{random.randrange(1000)}"
        rows.append((d, " ".join(w)))
    want = groups(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert near(spark, df) == want
    monkeypatch.setattr(minhash_dedup, "NODE", 50)
    monkeypatch.setattr(minhash_dedup, "LEVELS", 2)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 40)
    assert near(spark, df) == want


def test_joining_links_join_all():
    ids, component = np.array([1, 2, 3, 4]), np.array([1, 1, 3, 4])
    sets = [np.arange(0, 10), np.arange(0, 10), np.arange(1, 10), np.arange(50, 60)]
    links = minhash_dedup.joining_links(ids, component, [s.astype(np.uint64) for s in sets], 80)
    assert len(links) == 1 and set(links[0]) & {1, 2} and 3 in links[0]


def test_deduplicated_keeps_one(spark, odd):
    got = minhash_dedup.deduplicated(odd, k=2)
    assert got.columns == odd.columns
    kept = sorted(((r["doc_id"], r["text"][:9] if r["text"] else r["text"]) for r in got.collect()), key=repr)
    assert [k for k in kept if k[0] in (1, 2, 9)] == [(1, None), (2, ""), (9, " \t\n")]
    assert [k[0] for k in kept if k[0] not in (1, 2, 9)] == [10, 3, 5, 7]


def test_words_and_shingles_cross_no_text():
    import pyarrow as pa

    data, starts = textops.utf8(pa.array(["ab c", None, "ab", " c\x0bAB"]))
    hashes, text = textops.word_hashes(data, starts)
    assert text.tolist() == [0, 0, 2, 3, 3] and hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[3]


def test_components(spark):
    random.seed(5)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, k) for k in range(101, 400)] + [(random.randrange(500, 600), random.randrange(500, 600)) for _ in range(60)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    least = {}
    for a, b in links:
        for x in (a, b):
            least.setdefault(x, x)
    while True:
        changed = False
        for a, b in links:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
        if not changed:
            break
    assert got == {k: v for k, v in least.items() if any(k in p and p[0] != p[1] for p in links)}


# 3 ---------------------------------------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    d = spark.read.parquet(str(DATA / "sf0.01" / "documents.parquet"))
    got = language_id.language_of_documents(d).join(d.select("doc_id", "lang", "text"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    right, sure = np.array([r["lang"] == r["lang_pred"] for r in held]), np.array([r["score"] for r in held])
    assert abs(right.mean() - sure.mean()) < 0.03  # calibrated


def test_language_never_learns_from_held_out_or_inputs(spark, docs):
    """Other labels and sources on held-out rows change nothing."""
    changed = docs.withColumn("lang", F.when(common.crc_mod(F.col("doc_id"), 3) == 1, "zz").otherwise(F.col("lang"))).withColumn("source", F.lit("s"))
    a, b = (sorted(map(tuple, language_id.language_of_documents(d).collect())) for d in (docs, changed))
    assert a == b and "zz" not in {r[2] for r in b}


def test_language_odd_rows(spark, docs, odd):
    got = {r["doc_id"]: r for r in language_id.language_of_documents(docs.select("doc_id", "text", "lang").unionByName(odd.filter("doc_id IN (1, 2, 9)").select(F.col("doc_id") + 10_000_000, "text", "lang").toDF("doc_id", "text", "lang"))).collect()}
    assert [got[10_000_000 + i]["lang_pred"] for i in (1, 2, 9)] == ["und"] * 3
    empty = language_id.language_of_documents(odd.limit(0))
    assert empty.count() == 0
    unlabelled = language_id.language_of_documents(odd.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in unlabelled.collect()} == {"und"}
    assert language_id.filtered(docs).columns == docs.columns


# 4 ---------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check_packing(rows, got, tokenizer, capacity=2048):
    want = []
    for d, t in rows:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want.append((d, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted(want, key=repr) == sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got), key=repr)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= capacity
    return len(bins)


def test_packing(spark, docs, odd, tokenizer):
    got = packing.packed_documents(docs).collect()
    n = check_packing(pairs(docs), got, tokenizer)
    assert n <= math.ceil(sum(r["length"] for r in got) / 2048) + 1
    check_packing(ODD, packing.packed_documents(odd).collect(), tokenizer)
    assert packing.packed_documents(odd.limit(0)).count() == 0


def test_packing_over_partitions(spark):
    random.seed(1)
    rows = [(i, 0, 0, random.choice([random.randrange(1, 300), random.randrange(300, 1400)]), 0) for i in range(3000)]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(pieces, part_rows=200).collect()
    lengths = np.array([r[3] for r in rows])
    assert len(got) == 3000 and len({r["sequence_id"] for r in got}) <= 1.01 * packing.lower_bound(lengths, 2048) + 1


def test_lower_bound_never_exceeds_the_optimum():
    rng = random.Random(2)
    for _ in range(60):
        lengths = [rng.randrange(1, 11) for _ in range(rng.randrange(1, 8))]
        best = len(lengths)

        def search(i, bins):
            nonlocal best
            if len(bins) >= best:
                return
            if i == len(lengths):
                best = len(bins)
                return
            for j in range(len(bins)):
                if bins[j] + lengths[i] <= 10:
                    search(i + 1, [*bins[:j], bins[j] + lengths[i], *bins[j + 1 :]])
            search(i + 1, [*bins, lengths[i]])

        search(0, [])
        assert packing.lower_bound(np.array(lengths), 10) <= best
        used = packing.best_fit(np.array(sorted(lengths, reverse=True)), 10)[2]
        assert len(used) >= best
    assert packing.lower_bound(np.array([6] * 7), 10) == 7


def test_word_memory_is_exact_when_full(monkeypatch, tokenizer):
    import public_tokenizers

    monkeypatch.setattr(packing, "MEMO_WORDS", 16)
    w = packing.Words(public_tokenizers.path("word_bpe_49k.json"))
    texts = ["One two, three. Four five six seven eight nine ten!", "don't J̌ İ Σας é. x\x1cy a.b c.,", "x!!! don' (it's) 's s' a_ b__c é%% ß... k'll. <|endoftext|>!! q<|x|>", "", None, "one " * 50 + "two." * 9]
    assert [np.frombuffer(i, "<u4").tolist() for i in w.of(texts)] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


# 5 ---------------------------------------------------------------------------------------------------------------


def check_fingerprints(rows, got):
    order = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for i, (d, t) in enumerate(order):
        after, half = order[(i + 1) % len(order)][1], len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest()))
    assert sorted(want, key=repr) == sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got), key=repr)


@pytest.mark.parametrize("bucket, quantiles", [(3000, 1000), (7, 1000), (7, 3)])
def test_fingerprints(spark, docs, odd, monkeypatch, bucket, quantiles):
    monkeypatch.setattr(fingerprints, "BUCKET_ROWS", bucket)
    monkeypatch.setattr(fingerprints, "BUCKETS", quantiles)
    got = fingerprints.fingerprints(docs).collect()
    check_fingerprints(pairs(docs), got)
    text = dict(pairs(docs))
    seen = {}
    for r in got:
        assert seen.setdefault(text[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    long_ = [r for r in got if r["n_chars"] > 2000]
    assert 0.2 < np.mean([r["near_edited"] for r in long_]) < 0.5 and np.mean([r["near_next"] for r in long_]) < 0.05
    check_fingerprints(ODD, fingerprints.fingerprints(odd).collect())
    assert fingerprints.fingerprints(odd.limit(0)).count() == 0


def test_sketch_estimates(spark):
    a = " ".join(f"w{i}" for i in range(4000))
    rows = spark.createDataFrame([(a, " ".join(f"w{i}" for i in range(400)))], "a string, b string").select(fingerprints.sketch(F.col("a")).alias("a"), fingerprints.sketch(F.col("b")).alias("b"))
    r = rows.select(fingerprints.containment(F.col("b"), F.col("a")), fingerprints.likeness(F.col("a"), F.col("b")), fingerprints.merged(F.col("a"), F.col("b")) == F.col("a"), F.size("a")).first()
    assert r[0] == 1.0 and 0.05 < r[1] < 0.16 and r[2] and 800 < r[3] < 1200


# 6 ---------------------------------------------------------------------------------------------------------------

BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        total = sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(digits[::-1]))
        return 16 <= len(digits) <= 19 and total % 10 == 0
    return 8 <= len(digits) <= 15 if kind == "phone" else True


def base(text):
    return [(k, m.start(), m.end()) for k, p in BASE for m in re.finditer(p, text or "") if holds(k, m.group())]


PII_ODD = [(1, None), (2, ""), (None, "x@y.zz 1.2.3.4 256.1.1.1 a+b@c-d.e%f@g.h, 4111 1111 1111 1111 +49 (30) 1234567 +1 x@q\n1.2.3.4.5.6.7.8 é@a.b 漢 00255.01.1.1"), (4, "a" * 20 + "@" + "b." * 3000 + "c " + "1 " * 3000), (5, "+" * 3000), (6, "a" * 20000)]


def test_personal_data_base(spark, docs):
    for rows in (pairs(docs), PII_ODD):
        df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
        got = pii.personal_data(df).collect()
        want = []
        for d, t in rows:
            b = base(t)
            joined = ",".join(f"{k}:{i}:{j}" for k, i, j in b)
            n = Counter(k for k, _, _ in b)
            want.append((d, *[n[k] for k, _ in BASE], hashlib.sha256(joined.encode()).hexdigest()))
        assert sorted(want, key=repr) == sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in got), key=repr)
    assert pii.personal_data(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_disclosing_terms(spark):
    rows = [(i, f"note {i}: call Zorbulon at zed@example.org about item {i}") for i in range(5)]
    rows += [(10 + i, f"note {i} about item {i} from anyone, call them at home or write a{i}@example.org") for i in range(40)]
    rows += [(90, "call Zorbulon"), (91, "call Zorbulon at zed@example.org"), (92, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r["entity"], r["term"]) for r in pii.disclosing_terms(df, threshold=0.85).collect()} == {("email:zed@example.org", "zorbulon")}
    got = {r["doc_id"]: r["spans"] for r in pii.personal_data(df).collect()}
    assert got[0] == "email:25:40,term:13:21" and got[90] == "term:5:13" and ",term" not in got[10]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert clean[0] == "note 0: call  at [EMAIL] about item 0" and clean[90] == "call " and clean[92] is None


def test_copies_give_no_support(spark):
    df = spark.createDataFrame([(i, "call Zorbulon at zed@example.org") for i in range(9)] + [(50, "other words")], "doc_id long, text string")
    assert pii.disclosing_terms(df).count() == 0


def test_disclosing_terms_of_rare_values_in_whole_documents(spark):
    far = " and so on" * 30
    rows = [(i, f"Zorbulon spoke{far} mail zed@example.org on day {i}, {'yes' if i else 'no'}") for i in range(2)]
    rows += [(5, f"Quux spoke{far} mail q@example.org"), (6, None), (7, f"Twice spoke{far} mail t@example.org"), (8, f"Twice spoke{far} mail t@example.org")]
    rows += [(100 + i, f"spoke and mail so on day {i % 9}, yes or no") for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # Two contexts are enough for a word found nowhere else; one document and its copies never are.
    assert [tuple(r) for r in pii.disclosing_terms(df).collect()] == [("email:zed@example.org", "zorbulon")]
    assert pii.disclosing_terms(df, level=1e-9).count() == 0
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(df).collect()}
    assert clean[0] == f" spoke{far} mail [EMAIL] on day 0, no" and clean[5] == f"Quux spoke{far} mail [EMAIL]"


# 7 ---------------------------------------------------------------------------------------------------------------


def test_mixing_equals_sql_and_targets(spark):
    sf = DATA / "sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    df = mixing.mixed_sizes(spark.read.parquet(str(sf / "documents.parquet")))
    names = ["doc_id", "size", "source_size", "target", "taken"]
    want = sorted(con.execute(f"SELECT {', '.join(names)} FROM ({mixing.ORACLE})").fetchall())
    got = sorted(map(tuple, df.select(*names).collect()))
    assert got == want


def fill(sizes, weights, cap=3):
    """Targets by repeated sharing."""
    total, target = sum(sizes), [None] * len(sizes)
    while True:
        open_ = [i for i, t in enumerate(target) if t is None]
        left = total - sum(cap * sizes[i] for i, t in enumerate(target) if t is not None)
        over = [i for i in open_ if weights[i] * left / sum(weights[j] for j in open_) > cap * sizes[i]]
        if not over:
            return [cap * sizes[i] if target[i] is not None else weights[i] * left / sum(weights[j] for j in open_) for i in range(len(sizes))]
        for i in over:
            target[i] = cap * sizes[i]


def test_water_filling(spark):
    rng = random.Random(4)
    for _ in range(3):
        sizes = [rng.choice([0, 1, 5, 50, 1000, 20000]) for _ in range(rng.randrange(1, 12))]
        df = spark.createDataFrame([(f"s{i:02}", s) for i, s in enumerate(sizes)], "source string, size long")
        got = [r["target"] for r in mixing.source_targets(df).orderBy("source").collect()]
        assert got == pytest.approx(fill(sizes, [i % 3 + 1 for i in range(len(sizes))]) if sum(sizes) else [0.0] * len(sizes))


def test_mix_takes_copies(spark, odd):
    planned = {(r["doc_id"], r["size"]): r["taken"] for r in mixing.mixed_sizes(odd).collect()}
    assert all(t <= 3 * s for (_, s), t in planned.items())
    taken = mixing.mix(odd)
    assert taken.columns == odd.columns
    assert sorted(map(str, taken.collect())) == sorted(map(str, mixing.mix(odd).collect()))
    assert sum(len(words(r["text"])) for r in taken.collect()) == sum(r["taken"] for r in mixing.mixed_sizes(odd).collect())
    assert mixing.mix(odd.limit(0)).count() == 0


# 8 ---------------------------------------------------------------------------------------------------------------


def check_scores(rows, got):
    tokens = [[*words(t), None] for _, t in rows]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    c = Counter(w for t, h in zip(tokens, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    want = [(d, h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 5)) for (d, _), t, h in zip(rows, tokens, held)]
    assert sorted(want, key=repr) == sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 5)) for r in got), key=repr)


def test_lm_scores(spark, docs, odd, monkeypatch):
    monkeypatch.setattr(lm_scoring, "LOOKUP", 300)  # so that most words go through the shuffle
    got = lm_scoring.scored(docs).collect()
    check_scores(pairs(docs), got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    check_scores(ODD, lm_scoring.scored(odd).collect())
    assert lm_scoring.scored(odd.limit(0)).count() == 0


def test_lm_gradients():
    rng = np.random.default_rng(1)
    hashes = np.sort(rng.integers(2, 1 << 60, 30).astype(np.uint64))
    v = lm_scoring.Vocabulary(hashes, rng.integers(1, 50, 30), 2000, 100)
    w = {k: a.astype(np.float64) + rng.normal(0, 0.3, a.shape) for k, a in lm_scoring.initial(v).items()}
    y = rng.integers(0, v.size, (5, 3))
    y[4, 2] = -1
    x = np.maximum(np.roll(y, 1, axis=0), 0)
    h = rng.normal(0, 0.5, (3, lm_scoring.HIDDEN))
    total = lambda: -lm_scoring.train_segment(w, v, x, y, h)[2] * 14
    grads, _, _ = lm_scoring.train_segment(w, v, x, y, h)
    rows, found = grads["E"]
    grads["E"] = np.zeros_like(w["E"])
    grads["E"][rows] = found
    assert set(grads) == set(w)
    for name, g in grads.items():
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in w[name].shape)
            kept = w[name][at]
            w[name][at] = kept + 1e-5
            up = total()
            w[name][at] = kept - 1e-5
            down = total()
            w[name][at] = kept
            assert (up - down) / 2e-5 == pytest.approx(g[at], rel=1e-3, abs=1e-6)


def test_lm_streams_equal_single_documents_and_sum_to_one():
    rng = np.random.default_rng(2)
    v = lm_scoring.Vocabulary(np.arange(2, 42, dtype=np.uint64), rng.integers(1, 50, 40), 3000, 200)
    w = {k: (a + rng.normal(0, 0.2, a.shape)).astype(np.float32) for k, a in lm_scoring.initial(v).items()}
    texts = [rng.integers(0, v.size, n).astype(np.int32) for n in (3, 200, 1, 70, 130, 5, 66)]
    together = lm_scoring.score_streams(w, v, texts, lanes=3)
    alone = [lm_scoring.score_streams(w, v, [t])[0] for t in texts]
    assert together == pytest.approx(alone, rel=1e-4)
    ends = [lm_scoring.score_streams(w, v, [np.append(texts[0], i).astype(np.int32)])[0] - alone[0] for i in range(v.size)]
    assert np.exp(ends).sum() == pytest.approx(1.0, rel=1e-4)


def test_lm_trains_on_every_token(spark):
    rows = [(1, "a b c d " * 500), (2, "b a"), (2, "b a"), (None, None), (3, "c " * 33)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    common.small_batches(spark)
    counts = lm_scoring.count_tokens(df.select("text")).toPandas()
    v = lm_scoring.Vocabulary(counts["h"].to_numpy(np.int64).view(np.uint64), counts["n"].to_numpy(np.int64), int(counts["n"].sum()), len(counts))
    got = [(r["doc_id"], np.frombuffer(r["ids"], np.int16), r["n_tokens"]) for r in lm_scoring.numbered(df.withColumn("held_out", F.lit(False)), v).collect()]
    assert sorted(((d, len(i), n) for d, i, n in got), key=repr) == sorted(((d, len(words(t)) + 1, len(words(t)) + 1) for d, t in rows), key=repr)
    assert Counter(v.lookup[np.concatenate([i for _, i, _ in got]) - 1].tolist()) == dict(zip(v.lookup.tolist(), v.counts.tolist()))
    assert lm_scoring.train_documents(lm_scoring.initial(v), v, [i for _, i, _ in got], lanes=2) == v.total


def test_lm_training_carries_the_state_through_a_document(monkeypatch):
    rng = np.random.default_rng(4)
    v = lm_scoring.Vocabulary(np.arange(2, 42, dtype=np.uint64), rng.integers(1, 50, 40), 3000, 200)
    texts, calls, run = [rng.integers(0, v.size, n).astype(np.int16) for n in (100, 7, 40, 64)], [], lm_scoring.train_segment

    def seen(w, v, x, y, h):
        out = run(w, v, x, y, h)
        calls.append((x, y, h, out[1]))
        return out

    monkeypatch.setattr(lm_scoring, "train_segment", seen)
    lm_scoring.train_documents(lm_scoring.initial(v), v, texts[:1])
    assert np.concatenate([y[:, 0] for _, y, _, _ in calls])[:100].tolist() == texts[0].tolist()
    assert np.concatenate([x[:, 0] for x, _, _, _ in calls])[1:100].tolist() == texts[0][:-1].tolist()
    assert not calls[0][2].any() and all((b[2] == a[3]).all() for a, b in zip(calls, calls[1:]))
    calls.clear()
    # Two lanes: the second document ends first, and the third starts in its lane with a new state.
    assert lm_scoring.train_documents(lm_scoring.initial(v), v, texts, lanes=2) == sum(map(len, texts))
    begins = [(x[0] == v.end) & ~h.any(axis=1) for x, _, h, _ in calls]
    assert sum(int(b.sum()) for b in begins) == len(texts)


def test_table_of_keys():
    keys = np.unique(np.random.default_rng(3).integers(0, 1 << 62, 5000).astype(np.uint64))
    t = lm_scoring.Table(keys)
    assert (t.find(keys) == np.arange(len(keys))).all() and (t.find(keys + np.uint64(1)) < 0).sum() >= len(keys) - 2
    assert (lm_scoring.Table(keys[:0]).find(keys) < 0).all()


# 9 ---------------------------------------------------------------------------------------------------------------


def repeats(rows, n=100):
    seen, out = {}, []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        b, gone = (t or "").encode(), bytearray(len((t or "").encode()))
        for p in range(len(b) - n + 1):
            if seen.setdefault(b[p : p + n], (d, p)) != (d, p):
                gone[p : p + n] = b"\1" * n
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def removed(df):
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeats_removed(df).collect()), key=repr)


@pytest.fixture(scope="module")
def repeated(spark):
    random.seed(1)
    parts = ["".join(random.choice(["ab", "c ", "xyzé", "0"]) for _ in range(k)) for k in (60, 120, 400)]
    rows = [(1, None), (2, ""), (3, "a" * 99), (4, "a" * 100), (5, "a" * 350), (6, "ab" * 300), (7, "b" * 50 + "a" * 120), (None, "q" * 130), (200, "q" * 130), (200, "q" * 130)]
    for k in range(8, 90):
        rows.append((k, "".join(random.choice(parts)[random.randrange(40) : random.randrange(60, 400)] + random.choice(["", "-", "q" * random.randrange(130)]) for _ in range(random.randrange(6)))))
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("hot, often", [(20_000, 64), (2, 10**9), (20_000, 2), (2, 3)])
def test_repeats(spark, docs, repeated, monkeypatch, hot, often):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "OFTEN", often)
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 2)
    assert removed(docs) == repeats(pairs(docs))
    rows, df = repeated
    assert removed(df) == repeats(rows)


def test_repeats_empty(spark):
    assert suffix_dedup.repeats_removed(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_bucket_refinement():
    rng = np.random.default_rng(5)
    data = np.concatenate([rng.integers(97, 99, 300), np.full(200, 97), rng.integers(97, 99, 300)]).astype(np.uint8)
    begin = np.arange(len(data) - 100)
    ident = suffix_dedup.refined(data, begin)
    raw = [data[p : p + 100].tobytes() for p in begin]
    first = {}
    assert all(first.setdefault(r, i) == i for r, i in zip(raw, ident)) and len(set(ident.tolist())) == len(set(raw))


# 10 --------------------------------------------------------------------------------------------------------------


def near_vectors(rows):
    good = [i for i, v, k in rows if i is not None]
    out = []
    unit = []
    for i, v, k in rows:
        ok = i is not None and k is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / max(abs(x) for x in v) if ok else None)
    root = list(range(len(rows)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(len(rows)):
            if a != b and unit[a] is not None and unit[b] is not None and rows[a][2] == rows[b][2] and len(unit[a]) == len(unit[b]):
                if unit[a] @ unit[b] / (np.linalg.norm(unit[a]) * np.linalg.norm(unit[b])) >= 0.98:
                    links[a] += 1
                    root[find(a)] = find(b)
    for a, (i, _, _) in enumerate(rows):
        own = [rows[b][0] for b in range(len(rows)) if find(b) == find(a)]
        out.append((i, links[a], min(own) if unit[a] is not None else i))
    assert good
    return sorted(out, key=repr)


@pytest.mark.parametrize("cell", [2000, 25])
def test_near_vectors(spark, monkeypatch, cell):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    linked = embedding_dedup.linked
    monkeypatch.setattr(embedding_dedup, "linked", lambda v: linked(v, cell=cell))
    rng = np.random.default_rng(6)
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.01], 1), (2, [2.0, 0.01], 1), (3, [1.0, 0.0], None), (4, None, 1), (5, [0.0, 0.0], 1), (6, [float("nan"), 1.0], 1), (7, [None, 1.0], 1)]
    rows += [(None, [1.0, 0.0], 1), (8, [1.0, 0.0, 0.0], 1), (9, [1.0, 0.0], 2), (10, [], 1), (11, [1e30, 0.0], 1), (12, [float("inf"), 1.0], 1)]
    centres = rng.normal(size=(6, 16))
    for k in range(200):
        rows.append((100 + k, [float(np.float32(x)) for x in centres[k % 6] + rng.normal(0, 0.14 * rng.random(), 16)], k % 2))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cell", F.lit(1)).repartition(3)
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_vectors(df).collect()), key=repr)
    assert got == near_vectors([(i, v and [x if x is None else float(np.float32(x)) for x in v], k) for i, v, k in rows])
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


# pipeline --------------------------------------------------------------------------------------------------------


def test_pipeline(spark, tokenizer):
    import corpus_pipeline

    d = spark.read.parquet(str(SF / "documents.parquet"))
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before, d = d, common.materialise(stage(spark, d, str(SF)), "stage")
        sizes.append(d.count())
        if name != "best-fit packing":
            assert d.columns == before.columns
        if name == "MinHash near-dedup":
            texts = pairs(before)
            assert {r[0] for r in pairs(d)} == {c for _, _, c in groups(texts, k=5)}
        if name == "personal data":
            assert not any(base(t) for _, t in pairs(d))
    check_packing(pairs(before), d.collect(), tokenizer)
    assert corpus_pipeline.run(spark, str(SF)).count() == sizes[-1]
    assert 190 <= sizes[0] <= 200 and json.dumps(sizes)
