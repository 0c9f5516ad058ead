"""The accuracy record of a reading: all text metrics with their summary, and which characters are missing."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from . import text as x
from .defaults import js_round

_CHARACTER = [StructField("character", StringType()), StructField("count", LongType())]
ANALYSIS = StructType([
    StructField("missing_words", ArrayType(StringType())),
    StructField("missing_characters", ArrayType(StructType([*_CHARACTER, StructField("source_words", ArrayType(StringType()))]))),
    StructField("extra_characters", ArrayType(StructType(_CHARACTER))),
    StructField("missing_total", LongType()),
    StructField("extra_total", LongType()),
])
MEASURES = StructType([
    StructField("distance", LongType()),
    StructField("order_free_distance", LongType()),
    StructField("read_length", IntegerType()),
    StructField("truth_length", IntegerType()),
    StructField("character_accuracy", DoubleType()),
    StructField("coverage", DoubleType()),
    StructField("differences", ArrayType(StructType([StructField("position", IntegerType()), StructField("want", StringType()), StructField("got", StringType())]))),
])
SOURCES = 5


_BETWEEN = re.compile(rf"(?:{x.SPACE}|{x.MARKS})+", re.ASCII)


def _analysis(text: str, truth: str) -> dict:
    got, want = ([w for w in _BETWEEN.split(t) if w] for t in (text, truth))
    have, need = Counter("".join(got)), Counter("".join(want))  # in the order in which characters first stand
    short = {c: n - have[c] for c, n in need.items() if n > have[c]}
    keys, names = set(short), dict.fromkeys(want)
    whole = {w for w in names if keys.issuperset(w)}
    sources: dict[str, list] = {c: [] for c in short}
    for w in names:
        if w not in whole and not keys.isdisjoint(w):
            for c in keys.intersection(w):
                sources[c].append(w)
    in_gone = {c for w in whole for c in w}
    missing = [{"character": c, "count": n, "source_words": sources[c][:SOURCES]} for c, n in short.items() if c not in in_gone or sources[c]]
    extra = [{"character": c, "count": n - need[c]} for c, n in have.items() if n > need[c]]
    gone = [w for w in want if w in whole]
    return {"missing_words": gone, "missing_characters": missing, "extra_characters": extra, "missing_total": sum(short.values()), "extra_total": sum(e["count"] for e in extra)}


_NONE = {"missing_words": [], "missing_characters": [], "extra_characters": [], "missing_total": 0, "extra_total": 0}


@F.arrow_udf(ANALYSIS)
def _analysed(text: pa.Array, truth: pa.Array) -> pa.Array:
    return x.sliced(_analysis, to_arrow_type(ANALYSIS), text, truth, none=_NONE)


#: What ``x.SPACE`` matches, by code point
_SPACE = np.zeros(0x110000, bool)
_SPACE[[*range(0x09, 0x0E), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]] = True


def _sampled(a: str, b: str) -> int:
    """``x.edit_distance`` of two texts."""
    k = -(-max(len(a), len(b), 1) // x.LARGE)
    return x.edits(a[::k], b[::k]) * k


def _measures(text: str, truth: str) -> dict:
    """What ``x`` says of two texts, from their code points, which are taken once."""
    a, b = (np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in (text, truth))
    n, m = len(a), len(b)
    short, most = min(n, m), max(n, m)
    forms = [np.sort(c[~_SPACE[c]]).tobytes().decode("utf-32-le", "surrogatepass") for c in (a, b)]
    same = a[:short] == b[:short]
    step, limit = (-(-most // 1000), 50) if most > x.LARGE else (1, 100)
    at = np.flatnonzero(np.append(~same, np.ones(most - short, bool)))
    want = set(truth)
    empty = 0.0 if n else 100.0
    return {
        "distance": _sampled(text, truth), "order_free_distance": _sampled(*forms), "read_length": len(forms[0]), "truth_length": len(forms[1]),
        "character_accuracy": int(same.sum()) * 100.0 / m if m else empty, "coverage": len(want & set(text)) * 100.0 / len(want) if m else empty,
        "differences": [{"position": i, "want": truth[i] if i < m else "(end)", "got": text[i] if i < n else "(end)"} for i in at[at % step == 0][:limit].tolist()],
    }


@F.arrow_udf(MEASURES)
def _measured(text: pa.Array, truth: pa.Array) -> pa.Array:
    return x.sliced(_measures, to_arrow_type(MEASURES), text, truth)


def character_analysis(text, truth) -> Column:
    """struct: words of the truth all of whose characters are short; other characters that are short, with
    how many are and up to five words they stand in (outside of missing words); characters read too often;
    both totals. Order is that of first appearance; word lists and counters of a text have no form in
    built-in functions, so texts go to an Arrow function, which splits them into words."""
    column = lambda c: F.col(c) if isinstance(c, str) else c
    return _analysed(column(text), column(truth))


def by_count(characters) -> Column:
    """Most frequent first; of equals the one that came first."""
    placed = F.transform(characters, lambda c, i: F.struct((-c["count"]).alias("n"), i.alias("i"), c.alias("c")))
    return F.transform(F.array_sort(placed), lambda p: p["c"])


def accuracy_records(readings: DataFrame, text: str, truth: str) -> DataFrame:
    """``readings`` with a struct ``record``: rates, accuracies, counts, lengths, distances, the first
    differing places, the analysis of characters and the summary. Texts are normalised first and go once to Arrow
    functions, which take all measures of a pair together."""
    rows = readings.withColumns({"_a": x.normalized(text), "_b": x.normalized(truth)})
    rows = rows.withColumns({"_m": _measured("_a", "_b"), "_analysis": character_analysis("_a", "_b")})
    missing = F.col("_a").isNull() | F.col("_b").isNull()
    held = lambda name, one: F.when(missing, one).otherwise(F.col(f"_m.{name}"))
    rows = rows.withColumns({
        "_d": F.col("_m.distance"), "_fd": F.col("_m.order_free_distance"), "_diff": F.col("_m.differences"), "_na": F.length("_a"), "_nb": F.length("_b"),
        "_la": held("read_length", F.length(x.sorted_form("_a"))), "_lb": held("truth_length", F.length(x.sorted_form("_b"))),
        "_place": held("character_accuracy", x.position_accuracy("_a", "_b")), "_cover": held("coverage", x.charset_coverage("_a", "_b")),
    })
    empty = F.when(F.col("_na") == 0, 0.0).otherwise(1.0)
    longest = F.greatest("_la", "_lb")
    rows = rows.withColumns({
        "_cer": F.when(F.col("_nb") == 0, empty).otherwise(F.try_divide(F.col("_d").cast("double"), F.col("_nb"))),
        "_ocer": F.when(longest == 0, F.lit(0.0)).otherwise(F.try_divide(F.col("_fd").cast("double"), longest)),
    })
    two = lambda c: F.format_string("%.2f", c)
    accuracy = js_round(F.greatest(F.lit(0.0), (F.lit(1.0) - F.col("_ocer")) * 100), 2)
    most, n = F.greatest("_na", "_nb"), F.size("_diff")
    limit = F.when(most > x.LARGE, 50).otherwise(100)
    line = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    whole = lambda c: F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
    same = F.col("_na") == F.col("_nb")
    # fixed values: the lines of a summary
    summary = F.concat_ws(
        "\n",
        line("Position-Sensitive Accuracy: ", two((F.lit(1.0) - F.col("_cer")) * 100), "%"), line("Extraction Accuracy ⭐: ", two(accuracy), "%"),
        line("Character Accuracy: ", two(F.col("_place")), "%"), line("Character Set Coverage: ", two(F.col("_cover")), "%"),
        line("Edit Distance: ", whole("_d")), line("Order-Independent Edit Distance: ", whole("_fd")),
        line("Character Count: ", whole("_na"), "/", whole("_nb"), " ", F.when(same, "match").otherwise("mismatch")),
        line("Normalized Length (no whitespace): ", whole("_la"), "/", whole("_lb")),
        F.when(n > 0, line("Found ", whole(n), F.when(n >= limit, "+").otherwise(""), " character differences")).otherwise("Perfect match!"),
        F.when(most > x.LARGE, line("Note: Large text detected (", whole(most), " chars) - using memory-efficient sampling mode")),
    )
    record = F.struct(
        js_round("_cer", 4).alias("error_rate"), js_round("_ocer", 4).alias("order_free_error_rate"), accuracy.alias("order_free_accuracy"), F.col("_fd").alias("order_free_distance"),
        js_round("_place", 2).alias("character_accuracy"), js_round("_cover", 2).alias("coverage"), F.col("_na").alias("read_count"), F.col("_nb").alias("truth_count"), same.alias("same_count"),
        (F.col("_na") - F.col("_nb")).alias("count_difference"), F.col("_la").alias("read_length"), F.col("_lb").alias("truth_length"), F.col("_d").alias("distance"),
        F.col("_diff").alias("differences"), F.col("_analysis").alias("analysis"), summary.alias("summary"),
    )
    return rows.withColumn("record", record).drop(*[c for c in rows.columns if c.startswith("_") and c not in readings.columns])


def source_counts(boxes: DataFrame, keys: list[str], sources: list[str], column: str = "source") -> DataFrame:
    """How many boxes came from each source; a source without any is null."""
    count = lambda s: F.nullif(F.count_if(F.col(column) == s), F.lit(0).cast("long"))
    return boxes.groupBy(*keys).agg(*[count(s).alias(s) for s in sources])
