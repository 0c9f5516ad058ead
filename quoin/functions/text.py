"""Text metrics and text clean-up as column expressions. Lengths are in code points."""

from __future__ import annotations

import os
import unicodedata
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from .defaults import js_round

SPACE = r"[\s\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
MARKS = "[、。，．！？]"
LARGE, SHORT, SLICE = 10_000, 256, 64


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def sliced(one: Callable, kind: pa.DataType, *columns: pa.Array, none=None) -> pa.Array:
    """``one`` of each row (``none`` where an argument is null), as an array. A batch has as many rows as the session
    says, of texts of any length; only a slice of it stands as Python objects at a time."""
    parts = []
    for at in range(0, max(len(columns[0]), 1), SLICE):
        rows = zip(*[c.slice(at, SLICE).to_pylist() for c in columns])
        parts.append(pa.array([none if any(v is None for v in row) else one(*row) for row in rows], kind))
    return pa.concat_arrays(parts)


@F.arrow_udf(StringType())
def _nfkc(s: pa.Array) -> pa.Array:
    return sliced(lambda t: unicodedata.normalize("NFKC", t), pa.string(), s)


def normalized(text) -> Column:
    """NFKC; texts of ASCII alone, which it leaves as they are, do not leave the JVM's value."""
    c = _c(text)
    return F.when(F.octet_length(c) == F.length(c), c).otherwise(_nfkc(c))


def _trimmed(a: str, b: str) -> tuple[str, str]:
    """The longer and the shorter text without what both begin and end with."""
    if len(a) < len(b):
        a, b = b, a
    n = len(os.path.commonprefix((a, b)))
    a, b = a[n:], b[n:]
    n = len(os.path.commonprefix((a[::-1], b[::-1])))
    return a[: len(a) - n], b[: len(b) - n]


def _bits(a: str, b: str) -> int:
    """Edit distance by bit vectors: a column of the table is two integers of as many bits as the longer text
    has characters, so a step costs its bits, not its cells."""
    a, b = _trimmed(a, b)
    if not b:
        return len(a)
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    full, top, distance = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = full, 0  # where the column rises and falls
    for c in b:
        same = at.get(c, 0)
        level = (((same & up) + up) ^ up | same | down) & full
        right, left = down | full & ~(up | level), up & level
        if right & top:
            distance += 1
        elif left & top:
            distance -= 1
        right = (right << 1 | 1) & full
        up, down = (left << 1 | full & ~(right | level)) & full, right & level
    return distance


def _banded(a: str, b: str, most: int) -> int:
    """Edit distance where it is at most ``most``, else more than that. Only the diagonals that so many edits reach
    are kept: the bits slide along with them. ``a`` is not the shorter one, by at most ``most``."""
    n, m, width = len(a), len(b), 2 * most + 1
    full, top = (1 << width) - 1, 1 << width - 1
    up, down, far, last = full ^ (1 << most) - 1, 0, most, 2 * most + m - n
    edge = top >> 1
    step = max(SHORT, width)
    for start in range(0, m, step):
        at: dict[str, int] = {}
        low = start - most  # the place of bit 0
        for i in range(max(low, 0), min(n, start + step + most)):
            at[a[i]] = at.get(a[i], 0) | 1 << i - low
        for i in range(start, min(start + step, m)):
            same = at.get(b[i], 0) >> i - start & full
            level = (((same & up) + up) ^ up | same | down) & full
            right, left = down | full ^ (level | up), level & up
            if i < n - most:  # down the lowest diagonal, then along the last row
                far += not level & top
            else:
                far += (right & edge != 0) - (left & edge != 0)
                edge >>= 1
            if far > last:
                return most + 1
            level >>= 1
            up, down = left | full ^ (level | right), level & right
    return far


def edits(a: str, b: str) -> int:
    """Edit distance. Readings are mostly like their truth, so bands are tried first, each four times as wide as the
    one before it; where they are no less work than the whole, or fail, the whole is taken."""
    a, b = _trimmed(a, b)
    most = max(SHORT // 8, len(a) // 10, len(a) - len(b))
    while 4 * most < len(b):
        far = _banded(a, b, most)
        if far <= most:
            return far
        most *= 4
    return _bits(a, b)


def within(a: str, b: str, most: int) -> int:
    """Edit distance where it is at most ``most``, else more than that: of the bands of ``edits`` the one that counts."""
    a, b = _trimmed(a, b)
    if not b or len(a) - len(b) > most or not most:
        return len(a)
    return _banded(a, b, most) if 4 * most < len(b) else _bits(a, b)


@F.arrow_udf(LongType())
def _far(a: pa.Array, b: pa.Array, rate: pa.Array) -> pa.Array:
    return sliced(lambda x, y, k: edits(x[::k], y[::k]) * k, pa.int64(), a, b, rate)


def _distance(a: Column, b: Column, rate: Column) -> Column:
    """The built-in function fills a cell for each pair of characters; where a text has more than ``SHORT``
    characters an Arrow function takes some hundred times fewer steps. Short texts do not go there."""
    near = F.when((F.length(a) <= SHORT) & (F.length(b) <= SHORT), F.levenshtein(a, b).cast("long"))
    return F.coalesce(near, _far(F.when(near.isNull(), a), F.when(near.isNull(), b), rate))


def levenshtein(a, b) -> Column:
    """Edit distance of whole texts."""
    return _distance(_c(a), _c(b), F.lit(1))


def edit_distance(a, b, large: int = LARGE) -> Column:
    """The evaluated system's distance, for its accuracy record alone: above ``large`` characters, of every k-th
    character from the first on and times k. Other metrics take ``levenshtein``."""
    a, b = _c(a), _c(b)
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    return _distance(a, b, F.ceil(longest / F.lit(float(large))).cast("int"))


def error_rate(text, truth) -> Column:
    """Edit distance over the truth's length; for an empty truth 0 if nothing was read, else 1."""
    text, truth = _c(text), _c(truth)
    n = F.length(truth)
    empty = F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.lit(1.0))
    return F.when(n == 0, empty).otherwise(levenshtein(text, truth).cast("double") / n)


def chars(text) -> Column:
    return F.filter(F.split(_c(text), ""), lambda x: x != "")


def position_accuracy(text, truth) -> Column:
    """Percentage of the truth's places that hold the right character."""
    same = F.size(F.filter(F.zip_with(chars(text), chars(truth), lambda x, y: F.coalesce(x == y, F.lit(False))), lambda x: x))
    n = F.length(_c(truth))
    empty = F.when(F.length(_c(text)) == 0, F.lit(100.0)).otherwise(F.lit(0.0))
    return F.when(n == 0, empty).otherwise(same * F.lit(100.0) / n)


def charset_coverage(text, truth) -> Column:
    """Percentage of the truth's distinct characters that were read."""
    want = F.array_distinct(chars(truth))
    empty = F.when(F.length(_c(text)) == 0, F.lit(100.0)).otherwise(F.lit(0.0))
    return F.when(F.length(_c(truth)) == 0, empty).otherwise(F.size(F.array_intersect(want, chars(text))) * F.lit(100.0) / F.size(want))


def sorted_form(text) -> Column:
    """Characters without white space, sorted. The empty piece that a split ends with adds nothing."""
    return F.array_join(F.sort_array(F.split(F.regexp_replace(_c(text), f"{SPACE}+", ""), "")), "")


def order_free_error_rate(text, truth) -> Column:
    """Edit distance of the sorted forms over the longer one; 0 if both are empty."""
    return forms_error_rate(sorted_form(text), sorted_form(truth))


def forms_error_rate(a, b) -> Column:
    """The same of texts that are sorted already."""
    a, b = _c(a), _c(b)
    n = F.greatest(F.length(a), F.length(b))
    return F.when(n == 0, F.lit(0.0)).otherwise(levenshtein(a, b).cast("double") / n)


def order_free_accuracy(text, truth) -> Column:
    return js_round(F.greatest(F.lit(0.0), (F.lit(1.0) - order_free_error_rate(text, truth)) * 100), 2)


def similarity(a, b) -> Column:
    """1 - distance / longer length; 0 if either is empty."""
    a, b = _c(a), _c(b)
    n = F.greatest(F.length(a), F.length(b))
    return F.when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0)).otherwise(F.lit(1.0) - levenshtein(a, b).cast("double") / n)


def precision_recall_f1(text, truth) -> Column:
    """From the edit distance; may be negative."""
    d, n, m = levenshtein(text, truth).cast("double"), F.length(_c(text)), F.length(_c(truth))
    right = F.greatest(n, m) - d
    p = F.when(n > 0, right / n).otherwise(F.lit(0.0))
    r = F.when(m > 0, right / m).otherwise(F.lit(0.0))
    f = F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), f.alias("f1"))


def words(text) -> Column:
    """Split at white space and at Japanese commas, stops and marks."""
    return F.filter(F.split(_c(text), rf"(?:{SPACE}|{MARKS})+"), lambda x: x != "")


def segments(text) -> Column:
    """Words; those with CJK characters as single characters."""
    cjk = r"[　-〿぀-ゟ゠-ヿ＀-ﾟ一-龯]"
    parts = F.filter(F.split(_c(text), rf"{SPACE}+"), lambda x: x != "")
    return F.flatten(F.transform(parts, lambda x: F.when(x.rlike(cjk), chars(x)).otherwise(F.array(x))))


def trimmed(text) -> Column:
    return F.regexp_replace(_c(text), rf"^{SPACE}+|{SPACE}+$", "")


# The commentary that readers add, with the names reports use.
CODE_BLOCK = (r"```(?:text|plaintext)?\n?([\s\S]*?)\n?```", "markdown code block")
PREAMBLES = (
    (r"(?i)^Here is the extracted text:?\s*", "Here is..."),
    (r"(?i)^Here is what I extracted:?\s*", "Here is what..."),
    (r"(?i)^I found the following text:?\s*", "I found..."),
    (r"(?i)^Based on the image[,:]\s*", "Based on..."),
    (r"(?i)^The extracted text is:?\s*", "The extracted..."),
    (r"(?i)^Extracted text:?\s*", "Extracted text:"),
    (r"(?i)^Text from (?:the )?image:?\s*", "Text from image:"),
    (r"(?i)^(?:The )?OCR results?:?\s*", "OCR result:"),
)
TRAILERS = (
    (r"(?is)\n+Note:.*$", "trailing Note:"),
    (r"(?is)\n+Please note:.*$", "trailing Please note:"),
    (r"(?is)\n+\*\*Note:.*$", "trailing **Note:"),
)
OPENERS = (
    r"(?i)^here\s+is\s+the\s+extracted\s+text:?\s*",
    r"(?i)^extracted\s+text:?\s*",
    r"(?i)^the\s+text\s+in\s+the\s+image\s+is:?\s*",
    r"(?i)^text\s+found:?\s*",
    r"(?i)^ocr\s+result:?\s*",
    r"(?i)^i\s+found\s+the\s+following\s+text:?\s*",
    r"^以下のテキストを抽出しました:?\s*",
    r"^テキスト:?\s*",
)
CLOSERS = (r"(?i)\s*is\s+this\s+helpful\?$", r"(?i)\s*let\s+me\s+know\s+if.*$", r"(?i)\s*anything\s+else\?$")


def without_commentary(text) -> Column:
    """struct(cleaned, had_commentary, removed): what readers put around a text is taken off, in order."""
    c, flags = trimmed(text), []
    for pattern, name, by in [(*CODE_BLOCK, "$1"), *((p, n, "") for p, n in PREAMBLES + TRAILERS)]:
        flags.append(F.when(c.rlike(pattern), F.lit(name)))
        c = F.regexp_replace(c, pattern, by)
    removed = F.array_compact(F.array(*flags))
    return F.struct(trimmed(c).alias("cleaned"), (F.size(removed) > 0).alias("had_commentary"), removed.alias("removed"))


def without_openers(text) -> Column:
    c = trimmed(text)
    for pattern in OPENERS + CLOSERS:
        c = F.regexp_replace(c, pattern, "")
    return trimmed(c)


def text_blocks(text) -> Column:
    """Quoted stretches; without any, lines of three characters or more that are no headings."""
    quoted = F.regexp_extract_all(_c(text), F.lit("[「\"']([^「\"']+)[」\"']"), 1)
    lines = F.filter(F.transform(F.split(_c(text), "\n"), trimmed), lambda x: (F.length(x) > 2) & ~x.rlike("(?i)^(missing|incorrect|found|should|here|text|extracted)"))
    return F.when(F.size(quoted) > 0, quoted).otherwise(lines)


def html_escaped(text) -> Column:
    c = _c(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def interpolated(template, values) -> Column:
    """``{{key}}`` becomes the key's value; unknown keys stay."""
    return F.aggregate(F.map_entries(_c(values)), _c(template), lambda acc, e: F.replace(acc, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]))


def character_differences(text, truth, limit: int = 100, large_limit: int = 50) -> Column:
    """Places that differ (position, want, got): every place, above 10 000 characters every k-th; the
    first 100, for sampled texts 50. A missing character is ``(end)``."""
    a, b = chars(text), chars(truth)
    n = F.greatest(F.length(_c(text)), F.length(_c(truth)))
    step = F.when(n > LARGE, F.ceil(n / F.lit(1000.0))).otherwise(F.lit(1)).cast("int")
    end = F.lit("(end)")
    pairs = F.zip_with(a, b, lambda x, y: F.struct(F.coalesce(y, end).alias("want"), F.coalesce(x, end).alias("got")))
    all_ = F.transform(pairs, lambda d, i: F.struct(i.alias("position"), d["want"].alias("want"), d["got"].alias("got")))
    held = F.array(F.struct(F.filter(all_, lambda d: d["want"] != d["got"]).alias("d"), step.alias("step")))
    every = F.transform(held, lambda s: F.filter(s["d"], lambda d: d["position"] % s["step"] == 0))[0]
    return F.slice(every, 1, F.when(n > LARGE, F.lit(large_limit)).otherwise(F.lit(limit)))
