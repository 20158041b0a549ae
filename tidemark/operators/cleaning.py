"""Text of assembled documents: lines, document frequency, repeated chrome, redactions, important lines, titles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.noise import EXTENSIONS, collapsed_is_noise
from ..functions.text import collapse, ellipsis, line_key, lines, normalised

TOP, BOTTOM, REPEATED = 0.14, 0.82, 0.6
# Fixed value: simplified characters that lower a title's rank.
SIMPLIFIED = "值视图组"
# What is cut from a file's title, and what shows that a sentence goes on behind a file's name.
APPLICATION = r"(?i)\s*[-–—]\s*(PowerPoint|Word|Excel|Adobe Acrobat|Google Chrome|Microsoft Edge).*$"
KATAKANA_HYPHEN = r"(?<=[ァ-ヶ])-+(?=[ァ-ヶ])"
PATH_STEP = r"\s*(?:>|\\|/)\s*"
CONTINUED = "^[ぁ-んァ-ヶー一-龠]"


def exploded(pages: DataFrame, text: str = "ocr_text") -> DataFrame:
    """(group, page, pos, line, key) of pages (group, page, text): one row a line that isn't blank, in normal form."""
    pages = pages.select("group", "page", normalised(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    x = pages.select("group", "page", F.posexplode(lines(F.col("text"))).alias("pos", "raw"))
    x = x.withColumn("line", collapse(F.col("raw"))).filter(F.col("line") != "")
    return x.select("group", "page", "pos", "line", F.lower("line").alias("key"))


def document_frequency(rows: DataFrame) -> DataFrame:
    """(group, key, pages) in how many pages of its group each line occurs; equal lines of a page are merged before the shuffle."""
    return rows.groupBy("group", "key", "page").agg(F.lit(1).alias("one")).groupBy("group", "key").agg(F.count("one").alias("pages"))


def threshold(n: Column) -> Column:
    return F.greatest(F.lit(2), F.ceil(n * REPEATED)).cast("long")


def first_occurrences(rows: DataFrame) -> DataFrame:
    """The first line of each key of a page."""
    first = rows.groupBy("group", "page", "key").agg(F.min(F.struct("pos", "line")).alias("at"))
    return first.select("group", "page", "key", F.col("at.pos").alias("pos"), F.col("at.line").alias("line"))


def outer(center: Column) -> Column:
    return (center <= TOP) | (center >= BOTTOM)


def box(polygon: Column) -> Column:
    """Left, right, top and bottom of a polygon; null without points."""
    points = F.filter(polygon, lambda p: F.size(p) >= 2)

    def made(points: Column) -> Column:
        xs, ys = F.transform(points, lambda p: F.get(p, F.lit(0))), F.transform(points, lambda p: F.get(p, F.lit(1)))
        b = F.struct(F.array_min(xs).alias("left"), F.array_max(xs).alias("right"), F.array_min(ys).alias("top"), F.array_max(ys).alias("bottom"))
        return F.when(F.size(points) > 0, b)

    return bound(points, made)


def bound(c: Column, use: Callable[[Column], Column]) -> Column:
    """use(c), where c is made once however often use reads it: the optimiser puts what a column is made of in each place that reads it."""
    return F.transform(F.array(c), use).getItem(0)


def touched(b: Column, redactions: Column, width: Column, height: Column) -> Column:
    """A box that strictly overlaps a redaction in relative coordinates; with redactions and no box, touched too."""

    def hit(r: Column) -> Column:
        x, y = F.least(F.greatest(r["x"], F.lit(0.0)), F.lit(1.0)), F.least(F.greatest(r["y"], F.lit(0.0)), F.lit(1.0))
        w, h = F.least(F.greatest(r["width"], F.lit(0.0)), 1 - x), F.least(F.greatest(r["height"], F.lit(0.0)), 1 - y)
        return (b["left"] < (x + w) * width) & (b["right"] > x * width) & (b["top"] < (y + h) * height) & (b["bottom"] > y * height)

    return F.when(F.size(redactions) == 0, False).when(b.isNull(), True).otherwise(F.exists(redactions, hit))


LINES = "struct<lines:array<struct<text:string,confidence:double,polygon:array<array<double>>>>>"


def safe_lines(pages: DataFrame) -> DataFrame:
    """Pages (…, metadata_json, ocr_text, redactions, width, height) with the array ``safe`` of lines no redaction touches.

    Without line geometry the page's own text is used, unless there are redactions: then nothing is.
    """
    parsed = F.filter(F.coalesce(F.from_json("metadata_json", LINES)["lines"], F.array()), lambda x: collapse(x["text"]) != "")
    hit = lambda x: bound(box(x["polygon"]), lambda b: touched(b, F.col("redactions"), F.col("width"), F.col("height")))
    plain = F.transform(F.filter(lines(F.coalesce("ocr_text", F.lit(""))), lambda x: collapse(x) != ""), lambda x: F.struct(x.alias("text"), F.lit(None).cast("double").alias("confidence"), F.array().cast("array<array<double>>").alias("polygon")))
    safe = bound(parsed, lambda given: F.when(F.size(given) > 0, F.filter(given, lambda x: ~hit(x))).when(F.size("redactions") > 0, F.array().cast(kept_type())).otherwise(plain))
    return pages.withColumn("safe", safe)


def kept_type() -> str:
    return "array<struct<text:string,confidence:double,polygon:array<array<double>>>>"


def cleaned(pages: DataFrame) -> DataFrame:
    """(group, page, text) of pages (group, page, height, safe): distinct lines without noise and repeated outer chrome."""
    rows = pages.select("group", "page", "height", F.posexplode("safe").alias("pos", "x"))
    rows = rows.select("group", "page", "height", "pos", collapse(normalised(F.col("x.text"))).alias("line"), box(F.col("x.polygon")).alias("box"))
    rows = rows.filter(F.col("line") != "").withColumn("key", F.lower("line"))
    n = pages.groupBy("group").agg(F.count_distinct("page").alias("n"))
    often = document_frequency(rows).join(n, "group").filter(F.col("pages") >= threshold(F.col("n"))).select("group", "key", F.lit(True).alias("often"))
    center = (F.col("box.top") + F.col("box.bottom")) / 2 / F.col("height")
    kept = rows.join(often, ["group", "key"], "left")
    kept = kept.filter(~collapsed_is_noise(F.col("line"), F.col("key")) & ~F.coalesce(F.col("often") & (F.col("height") > 0) & outer(center), F.lit(False)))
    first = kept.groupBy("group", "page", "key").agg(F.min(F.struct("pos", "line")).alias("at"))
    texts = first.groupBy("group", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list("at")), lambda a: a["line"]), "\n").alias("text"))
    return pages.select("group", "page").join(texts, ["group", "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))


def important(text: Column, limit: int = 8) -> Column:
    """The first useful lines of a text in normal form, long ones cut."""
    useful = F.filter(F.transform(lines(text), collapse), lambda x: (x != "") & ~collapsed_is_noise(x))
    return F.transform(F.slice(useful, 1, limit), lambda x: ellipsis(x))


def title_candidates(rows: DataFrame) -> DataFrame:
    """rows (line, key) with file_title, from a line that shows a file's name, and plain, a line that may serve as title."""
    line = F.col("line")
    found = F.regexp_extract(line, rf"(?i)^(.+?\.(?:{EXTENSIONS}))", 1)
    trailing = F.substring(line, F.length(found) + 1, F.length(line))
    name = F.trim(F.regexp_replace(found, APPLICATION, ""))
    name = F.regexp_replace(F.regexp_replace(name, KATAKANA_HYPHEN, "ー"), rf"(?i)\.(?:{EXTENSIONS})$", "")
    name = F.trim(F.element_at(F.split(name, PATH_STEP), -1))
    shown = (found != "") & ~trailing.rlike(CONTINUED) & (name != "")
    plain = F.length(line).between(5, 100) & ~collapsed_is_noise(line, F.col("key"))
    return rows.withColumns({"file_title": F.when(shown, name), "plain": F.when(plain, line)})


def automatic_titles(rows: DataFrame) -> DataFrame:
    """(group, title) of lines (group, page, pos, line): the most frequent file title, else the most frequent line."""
    c = title_candidates(rows).select("group", "page", "pos", F.explode(F.array(F.struct(F.lit(1).alias("kind"), F.col("file_title").alias("value")), F.struct(F.lit(0).alias("kind"), F.col("plain").alias("value")))).alias("c"))
    c = c.select("group", "page", "pos", "c.kind", "c.value").filter(F.col("value").isNotNull())
    counted = c.groupBy("group", "kind", "value").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("page", "pos")).alias("first"))
    penalty = F.when(F.col("kind") == 1, F.length("value") - F.length(F.translate("value", SIMPLIFIED, ""))).otherwise(0)
    # The least of a struct is an aggregate with partial results, so a group's values don't meet in one window.
    rank = F.struct((-F.col("kind")).alias("a"), penalty.alias("b"), (-F.col("n")).alias("c"), (-F.length("value")).alias("d"), "first", "value")
    return counted.groupBy("group").agg(F.min(rank)["value"].alias("title"))


def line_keys_of(rows: DataFrame) -> DataFrame:
    return rows.withColumn("key", line_key(F.col("line")))
