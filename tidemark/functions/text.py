"""Text functions: native column expressions, and Arrow UDFs for what Spark has no function for."""

from __future__ import annotations

import re
import unicodedata
from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

# Look-alike characters and what they are between katakana.
LOOK_ALIKES = {"卜": "ト", "一": "ー", "二": "ニ", "力": "カ", "工": "エ", "夕": "タ", "口": "ロ", "八": "ハ", "-": "ー"}
_LOOK_ALIKE = re.compile("[" + re.escape("".join(LOOK_ALIKES)) + "]")
_KANA, _KANJI = re.compile("[ァ-ヶー]"), re.compile("[一-龠]")


def collapse(c: Column) -> Column:
    """White space runs as one blank, trimmed; the ideographic space counts."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def line_key(c: Column) -> Column:
    return F.lower(collapse(c))


def lines(c: Column) -> Column:
    """Lines of a text; a break at the end opens no line."""
    return F.split(F.regexp_replace(c, r"\R\z", ""), r"\R")


def query_tokens(c: Column) -> Column:
    """Tokens of a search query: letters, digits, _, - and . in any script, 32 at most."""
    return F.slice(F.regexp_extract_all(c, F.lit(r"(?U)[\w\-\.]+"), F.lit(0)), 1, 32)


def excerpt(c: Column, n: int = 500) -> Column:
    return F.substring(c, 1, n)


def ellipsis(c: Column, most: int = 140) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def encoded(c: Column) -> Column:
    """A text's UTF-8 bytes in base64, without line breaks."""
    return F.regexp_replace(F.base64(F.encode(c, "UTF-8")), r"\s", "")


def decoded(c: Column) -> Column:
    return F.decode(F.unbase64(c), "UTF-8")


def embedding_input(c: Column, kind: str = "passage") -> Column:
    """What an embedder reads: the trimmed text behind its kind, `passage` or `query`; null for a blank one."""
    text = F.trim(c)
    return F.when(text != "", F.concat(F.lit(f"{kind}: "), text))


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_like(c: Column) -> Column:
    for a in ("\\", "%", "_"):
        c = F.replace(c, F.lit(a), F.lit("\\" + a))
    return c


def occurrences(text: Column, token: str) -> Column:
    """Occurrences of a token, overlapping ones too, in text of the same case."""
    k = len(token)
    overlaps = any(token.startswith(token[i:]) for i in range(1, k))
    if overlaps:
        places = F.sequence(F.lit(1), F.greatest(F.length(text) - k + 1, F.lit(1)))
        count = F.size(F.filter(places, lambda i: F.substring(text, i, F.lit(k)) == token))
    else:
        count = ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / k).cast("int")
    return F.when(text.contains(token), count).otherwise(0)


def by_errors(a: np.ndarray, b: np.ndarray) -> int | None:
    """Levenshtein distance of code points by the furthest place on each diagonal with 0, 1, 2, … errors; None where by_bits takes less time.

    Takes time by the texts' length and the square of their distance.
    """
    n, m = len(a), len(b)
    a, b = np.append(a, _ENDS[0]), np.append(b, _ENDS[1])  # ends are like nothing, so no place goes beyond them
    left = 40_000 + n * m // 64  # steps of this way that take about the time of the other
    far, low = np.full(1, _run(a, b, 0, 0)), 0  # far[t]: the place in a on diagonal low + t, where it is that many less than in b
    errors = 0
    while not (low <= m - n < low + len(far) and far[m - n - low] == n):
        errors += 1
        first, last = max(low - 1, -n), min(low + len(far), m)
        wide = np.full(last - first + 3, -1)
        at = low - first + 1
        wide[at : at + len(far)] = far
        low, k = first, np.arange(first, last + 1)
        far = np.maximum(np.maximum(wide[1:-1], wide[2:]) + 1, wide[:-2])
        np.minimum(far, np.minimum(n, m - k), out=far)
        go = np.arange(len(far))
        for _ in range(6):
            go = go[a[far[go]] == b[far[go] + k[go]]]
            if not len(go):
                break
            far[go] += 1
        for t in go:
            far[t] += _run(a, b, far[t], far[t] + k[t])
        left -= 300 + 4 * len(far) + 100 * len(go)
        if left < 0:
            return None
    return errors


_ENDS = np.array([0xFFFFFFFE, 0xFFFFFFFF], np.uint32)


def _run(a: np.ndarray, b: np.ndarray, i: int, j: int) -> int:
    """How many code points are equal from i and j on; a and b have different ends."""
    at, size = i, 32
    while True:
        n = min(size, len(a) - i, len(b) - j)
        differ = a[i : i + n] != b[j : j + n]
        to = int(differ.argmax())
        if differ[to]:
            return i + to - at
        i, j, size = i + n, j + n, min(size * 4, 1 << 16)


def by_bits(a: np.ndarray, b: np.ndarray) -> int:
    """Levenshtein distance of code points, a column of the table of distances at a time, in bits (Myers, Hyyrö)."""
    if len(a) < len(b):
        a, b = b, a
    places = {c: int.from_bytes(np.packbits(a == c, bitorder="little").tobytes(), "little") for c in np.unique(b).tolist()}
    every = (1 << len(a)) - 1
    more, less = every, 0  # where the column grows and falls by one
    for c in b.tolist():
        same = places[c]
        down = same | less
        across = (((same & more) + more) ^ more) | same
        grows = less | (every & ~(across | more))
        falls = (more & across) << 1
        grows = (grows << 1) | 1
        more = (falls | ~(down | grows)) & every
        less = grows & down & every
    return len(b) + more.bit_count() - less.bit_count()


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance of whole texts in code points."""
    if a == b:
        return 0
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (a, b))
    short = min(len(a), len(b))
    unlike = np.flatnonzero(a[:short] != b[:short])
    start = int(unlike[0]) if len(unlike) else short
    a, b, short = a[start:], b[start:], short - start
    unlike = np.flatnonzero(a[len(a) - short :] != b[len(b) - short :])
    end = short - 1 - int(unlike[-1]) if len(unlike) else short
    a, b = a[: len(a) - end], b[: len(b) - end]
    if not len(a) or not len(b):
        return max(len(a), len(b))
    found = by_errors(a, b)
    return by_bits(a, b) if found is None else found


@F.pandas_udf(LongType())
def distance(a: pd.Series, b: pd.Series) -> pd.Series:
    """Levenshtein distance of whole texts in code points.

    The built-in function passes over the whole text for each character, with a limit too.
    """
    return pd.Series([None if x is None or y is None else edit_distance(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


def character_error_rate(truth: Column, found: Column) -> Column:
    d = distance(truth, found)
    return F.when(F.length(truth) == 0, F.when(F.length(found) == 0, 0.0).otherwise(1.0)).otherwise(d / F.length(truth))


def fold_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def normalise(value: str | None) -> str | None:
    """NFKC, then look-alikes beside katakana become kana, unless a kanji stands on either side; left to right."""
    if not value:
        return value
    text = unicodedata.normalize("NFKC", value)
    if not _KANA.search(text) or not _LOOK_ALIKE.search(text):
        return text
    done: list[str] = []
    for at, c in enumerate(text):
        if c in LOOK_ALIKES:
            around = (done[-1] if done else "", text[at + 1 : at + 2])
            kana = [bool(_KANA.match(x)) for x in around]
            blocked = any(_KANJI.match(x) and not k for x, k in zip(around, kana, strict=True))
            if any(kana) and not blocked:
                c = LOOK_ALIKES[c]
        done.append(c)
    return "".join(done)


@F.pandas_udf(StringType())
def normalise_text(s: pd.Series) -> pd.Series:
    return s.map(normalise, na_action="ignore")


def normalised(c: Column) -> Column:
    """A text's normal form; texts of ASCII alone have it already and don't go to Python."""
    return F.coalesce(normalise_text(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def similarity(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity."""
    return pd.Series([None if x is None or y is None else similarity(x, y) for x, y in zip(a, b, strict=True)], dtype=float)
