"""The classifier of lines that are window chrome, as one native predicate."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import collapse, normalised

# Labels and terms of user interfaces, applications, and extensions of file titles.
LABELS = [
    "検索", "q 検索", "ファイル", "ホーム", "挿入", "描画", "デザイン", "画面切り替え", "アニメーション", "スライドショー", "record", "校閲",
    "表示", "ヘルプ", "acrobat", "共有", "日本語", "ノート", "表示設定", "コメント", "アクセシビリティ：検討が必要です", "アクセシビリティ: 検討が必要です",
]
TERMS = ["ファイル", "ホーム", "挿入", "描画", "デザイン", "画面切り替え", "アニメーション", "スライドショー", "record", "校閲", "表示", "ヘルプ", "acrobat", "共有", "ノート", "表示設定"]
APPS = ["powerpoint", "word", "excel", "chrome", "edge"]
EXTENSIONS = "pptx?|docx?|xlsx?|pdf|py|ipynb|js|ts|tsx|jsx|java|cs|cpp|c|h|md|txt|ya?ml|json|html?|css"
ACCESS_KEY = r"[^\s()]+\([A-Za-z]\)"
SHAPES = [
    r"[+×□○●△▽◇◆★☆※*%]+",
    r"\d+[*/]\d+",
    r"スライド\s*\d+/\d+",
    r"\d{1,2}:\d{2}(?::\d{2})?",
    r"\d{4}[/-]\d{1,2}[/-]\d{1,2}",
    r"\d+(?:\.\d+)?%",
    r"-?\d+(?:\.\d+)?\s*℃",
]


def is_noise(line: Column) -> Column:
    """The predicate for any line: normal form first, so that full-width clocks, dates and labels count."""
    x = collapse(normalised(line))
    return collapsed_is_noise(x, F.lower(x))  # a lambda can't hold what runs in Python


def collapsed_is_noise(x: Column, low: Column | None = None) -> Column:
    """The predicate for a line in normal form whose white space is collapsed, and its lower case where that is at hand.

    Cheap tests stand before patterns, and patterns are anchored, so that a line takes linear time.
    """
    # A lambda's variable holds the line: a filter that is pushed below what makes the line would make it anew for each test.
    bound = F.struct(x.alias("x"), (F.lower(x) if low is None else low).alias("low"))
    return F.transform(F.array(bound), lambda b: _tests(b["x"], b["low"])).getItem(0)


def _tests(x: Column, low: Column) -> Column:
    terms = sum((low.contains(t).cast("int") for t in TERMS), F.lit(0))
    alone = F.lower(F.regexp_extract(x, r"^([^\s()]+)\([A-Za-z]\)$", 1))
    keys = x.contains("(") & ((F.regexp_count(x, F.lit(ACCESS_KEY)) >= 2) | alone.isin(LABELS))
    app = low.contains(APPS[0])
    for name in APPS[1:]:
        app = app | low.contains(name)
    titled = app & x.contains(".") & x.rlike(rf"(?i)^.+?\.(?:{EXTENSIONS})")
    shape = x.rlike("^(?:" + "|".join(SHAPES) + ")$")
    return (F.length(x) <= 1) | low.isin(LABELS) | keys | (terms >= 2) | titled | shape


def noise_sql(x: str) -> str:
    """The same predicate for the SQL side, over a collapsed line."""
    quoted = lambda items: ", ".join(f"'{i}'" for i in items)
    terms = " + ".join(f"contains(lower({x}), '{t}')::INT" for t in TERMS)
    apps = " OR ".join(f"contains(lower({x}), '{a}')" for a in APPS)
    return (
        f"(length({x}) <= 1 OR lower({x}) IN ({quoted(LABELS)}) OR len(regexp_extract_all({x}, '{ACCESS_KEY}')) >= 2 "
        rf"OR lower(regexp_extract({x}, '^([^\s()]+)\([A-Za-z]\)$', 1)) IN ({quoted(LABELS)}) OR {terms} >= 2 "
        rf"OR (regexp_matches({x}, '(?i).+?\.(?:{EXTENSIONS})') AND ({apps})) OR regexp_full_match({x}, '{'|'.join(SHAPES)}'))"
    )
