import pytest
from pyspark.sql import functions as F

from tidemark.functions.noise import is_noise
from tidemark.functions.text import character_error_rate, distance, ellipsis, lines, normalise, similarity
from tidemark.operators import cleaning as C


@pytest.mark.parametrize(
    "raw, want",
    [("⽇本", "日本"), ("テス卜", "テスト"), ("タ-ミナル", "ターミナル"), ("一番", "一番"), ("力士", "力士"), ("ＡＢＣ１", "ABC1"), ("a-b", "a-b"), ("", ""), (None, None), ("テス卜\nテス卜", "テスト\nテスト")],
)
def test_normalise(raw, want):
    assert normalise(raw) == want


@pytest.mark.parametrize(
    "line, want",
    [("表示(V) 移動(G) 実行(R)", True), ("ヘルプ(H)", True), ("ファイル ホーム 挿入", True), ("x", True), ("", True), ("12:30", True), ("2024/1/5", True), ("50%", True), ("スライド 3/10", True), ("3/10", True)]
    # The normal form comes first: full-width shapes count, and the degree sign falls apart, so that its shape never fits.
    + [("１２：３０", True), ("２０２４／１／５", True), ("５０％", True), ("21 ℃", False), ("表 示", False)]
    + [("report.pptx - PowerPoint", True), ("ordinary text (with brackets)", False), ("a plain sentence", False), ("計画(案)を確認", False)],
)
def test_noise(spark, line, want):
    assert spark.createDataFrame([(line,)], "x string").select(is_noise(F.col("x"))).first()[0] is want


def test_error_rate_and_ratio(spark):
    rows = spark.createDataFrame([("abcd", "abxd"), ("", ""), ("", "a")], "a string, b string")
    assert [r[0] for r in rows.select(character_error_rate(F.col("a"), F.col("b"))).collect()] == [0.25, 0.0, 1.0]
    assert similarity("abcd", "bcde") == 0.75


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def test_distance_of_whole_texts(spark):
    import random

    random.seed(3)
    texts = ["".join(random.choice("aé漢b ") for _ in range(random.randrange(400))) for _ in range(12)]
    pairs = [(a, b) for a in texts for b in (a, a[3:], a.replace("b", "rn"), random.choice(texts))] + [("", "xyz")]
    df = spark.createDataFrame(pairs, "a string, b string").select(distance(F.col("a"), F.col("b")))
    assert [r[0] for r in df.collect()] == [edit_distance(a, b) for a, b in pairs]


def test_distance_by_errors_and_by_bits():
    import random

    from tidemark.functions import text as T

    random.seed(4)
    codes = lambda x: T.np.frombuffer(x.encode("utf-32-le"), T.np.uint32)
    for _ in range(400):
        a = "".join(random.choice("ab漢😀") for _ in range(random.randrange(1, 40)))
        b = "".join(random.choice([c, c, c, "", c + "a"]) for c in a) if random.random() < 0.7 else "".join(random.choice("ab") for _ in range(20))
        want = edit_distance(a, b)
        assert T.edit_distance(a, b) == want and (not b or T.by_bits(codes(a), codes(b)) == want == T.by_errors(codes(a), codes(b)))
    assert T.by_errors(codes("ab" * 3000), codes("cd" * 3000)) is None and T.edit_distance("ab" * 3000, "cd" * 3000) == 6000


def test_distance_of_long_texts_is_quick(spark):
    import time

    # Each loss is alone between far letters, so that the distance is their number.
    text = "".join(f"{i:06d}{chr(0x4E00 + i % 9973)}" for i in range(30_000))
    lost = "".join(c for i, c in enumerate(text) if i % 1_001)
    df = spark.createDataFrame([(text, lost)] * 8, "a string, b string").select(distance("a", "b"))
    start = time.monotonic()
    assert {r[0] for r in df.collect()} == {len(text) - len(lost)} and time.monotonic() - start < 60


def test_cer_macro_equals_brute_force(spark, tmp_path):
    import pandas as pd

    from tidemark.plans.catalogue import QUERIES

    rows = [(i, t, "s" if i % 3 else "t", len(t)) for i, t in enumerate(["a modern barn", "", "ab", "yarn and horn é漢字" * 30, "plain text", "rn" * 50])]
    pd.DataFrame(rows, columns=["doc_id", "text", "source", "n_chars"]).to_parquet(tmp_path / "documents.parquet")
    rates = [(s, edit_distance(t, f) / len(t) if t else float(bool(f))) for _, t, s, _ in rows for f in [t[3:].replace("rn", "m")]]
    by = {s: [r for k, r in rates if k == s] for s, _ in rates}
    got = QUERIES["cer_macro"](spark, str(tmp_path)).first()
    assert got["n_cases"] == 6 and got["micro"] == pytest.approx(sum(r for _, r in rates) / 6) and got["macro"] == pytest.approx(sum(sum(v) / len(v) for v in by.values()) / 2)


def test_lines_and_ellipsis(spark):
    r = spark.createDataFrame([("a\nb\r\nc\n", "x" * 141)], "t string, l string").select(lines(F.col("t")), ellipsis(F.col("l"))).first()
    assert r[0] == ["a", "b", "c"] and len(r[1]) == 140 and r[1].endswith("...")


def titles(spark, texts):
    rows = C.exploded(spark.createDataFrame([("g", i, t) for i, t in enumerate(texts)], "group string, page long, ocr_text string"))
    return C.automatic_titles(rows).first()["title"]


def test_titles(spark):
    assert titles(spark, ["計画書.pptx - PowerPoint\n本文です、これは", "計画書.pptx - PowerPoint"]) == "計画書"
    assert titles(spark, ["C: > Users > me > PLAN.md\nsome words here"]) == "PLAN"
    assert titles(spark, ["rendererではNode.jsを無効にし\nthe common line\nthe common line", "the common line"]) == "the common line"


def pages(spark, rows):
    schema = "group string, page long, height int, width int, ocr_text string, metadata_json string, redactions array<struct<x:double,y:double,width:double,height:double>>"
    return C.safe_lines(spark.createDataFrame(rows, schema))


META = '{"lines":[{"text":"left words","confidence":0.9,"polygon":[[2,10],[20,10],[20,20],[2,20]]},{"text":"right words","confidence":0.9,"polygon":[[40,10],[60,10],[60,20],[40,20]]}]}'


def test_redactions(spark):
    cover = [(0.0, 0.0, 0.5, 1.0)]
    kept = pages(spark, [("g", 1, 36, 64, "left words\nright words", META, cover), ("g", 2, 36, 64, "no geometry", None, cover), ("g", 3, 36, 64, "plain\n\ntext", "{bad", [])])
    assert [[x["text"] for x in r["safe"]] for r in kept.orderBy("page").collect()] == [["right words"], [], ["plain", "text"]]


def test_repeated_outer_chrome_goes(spark):
    line = lambda text, y: f'{{"text":"{text}","confidence":0.9,"polygon":[[0,{y}],[9,{y}],[9,{y + 2}],[0,{y + 2}]]}}'
    rows = [("g", i, 100, 100, None, f'{{"lines":[{line("Site header", 1)},{line(f"body line {i}", 50)},{line("same body line", 60)},{line("same body line", 70)}]}}', []) for i in range(3)]
    texts = {r["page"]: r["text"] for r in C.cleaned(pages(spark, rows)).collect()}
    assert texts == {i: f"body line {i}\nsame body line" for i in range(3)}


def test_json_serialise_keeps_all_events(spark, tmp_path):
    from tidemark.plans.text_queries import json_serialise

    rows = [(999_999, "view", "{}"), (1_000_000, "é", "{}"), (5_000_000_000, "buy", None)]
    spark.createDataFrame(rows, "event_id long, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    got = {r["event_id"]: r["packed"] for r in json_serialise(spark, str(tmp_path)).collect()}
    assert got == {999_999: '{"event_id":999999,"event_type":"view"}', 1_000_000: '{"event_id":1000000,"event_type":"é"}', 5_000_000_000: None}


def test_json_serialise_equals_its_sql_on_odd_types(spark, tmp_path):
    import duckdb

    from tidemark.plans.catalogue import ORACLE_SQL, QUERIES

    rows = [(1, None, "{}"), (2, 'a"b\\c/d', "{}"), (3, "\x01\x1f\x7f\b\t\n", "{}"), (4, "é漢😀\u2028", "{}"), (5, "<&'>", None), (6, "", "{}")]
    spark.createDataFrame(rows, "event_id long, event_type string, props string").write.parquet(str(tmp_path / "events.parquet"))
    events = duckdb.read_parquet(f"{tmp_path}/events.parquet/*.parquet")  # noqa: F841  the SQL's table
    want = sorted(duckdb.sql(ORACLE_SQL["json_serialise"]).fetchall())
    assert sorted(tuple(r) for r in QUERIES["json_serialise"](spark, str(tmp_path)).collect()) == want
