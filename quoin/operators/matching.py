"""Order-dependent matching: exact replays, one group (page or document) at a time."""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@lru_cache(1 << 16)  # texts of drawings are few and short
def _distance(a: str, b: str, most: int) -> int:
    """Edit distance, or ``most`` + 1 above ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    prev = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(prev[j] + 1, row[j - 1] + 1, prev[j - 1] + (x != y)))
        prev = row
        if min(prev) > most:
            return most + 1
    return min(prev[-1], most + 1)


def _boxes(box: Column, name: str) -> Column:
    return F.sort_array(F.collect_list(box)).alias(name)


def pages(rows: DataFrame, key: str, item: Column, reference: Column) -> DataFrame:
    """A row for each page: key, items and refs, the structs ``item`` and ``reference`` of its rows where they are
    not null, in the order of their fields. Rows without a key are no references. Rows that are spread by their
    key already are not sent again."""
    return rows.groupBy(key).agg(_boxes(item, "items"), _boxes(F.when(F.col(key).isNotNull(), reference), "refs"))


def paged(items: DataFrame, references: DataFrame, key: str, columns: tuple[str, ...] = ("text", "x", "y")) -> DataFrame:
    """``pages`` of two frames: structs of item_id or ref_id and ``columns``; refs are null on a page without one."""
    refs = references.groupBy(key).agg(_boxes(F.struct("ref_id", *columns), "refs"))
    return items.groupBy(key).agg(_boxes(F.struct("item_id", *columns), "items")).join(refs, key, "left")


def greedy_pages(rows: DataFrame, close_edits: int = 2, near_edits: int = 5, near_pixels: float = 50.0) -> DataFrame:
    """``pages`` (text, x and y in both structs) with ``matches``: for each item the struct ref (place of its
    reference in ``refs``) and how, both null where it matches none. See ``greedy_one_to_one``."""

    def near(a, b) -> bool:
        return ((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) ** 0.5 < near_pixels and _distance(a[0], b[0], near_edits) <= near_edits

    rules = (("exact", lambda a, b: a[0] == b[0]), ("fuzzy", lambda a, b: _distance(a[0], b[0], close_edits) <= close_edits), ("spatial", near))

    def boxes(lists: pa.Array) -> tuple[list, list]:
        flat = lists.flatten()
        return lists.value_lengths().fill_null(0).to_pylist(), list(zip(*[flat.field(n).to_pylist() for n in ("text", "x", "y")]))

    def match(items: pa.Array, refs: pa.Array) -> pa.Array:
        (n_items, left), (n_refs, right) = boxes(items), boxes(refs)
        places, hows, ends, at = [], [], [0], 0
        for n, m in zip(n_items, n_refs):
            free = list(enumerate(right[at : at + m]))
            for row in left[ends[-1] : ends[-1] + n]:
                hit = next(((k, how) for how, test in rules for k, r in enumerate(free) if test(row, r[1])), None)
                places.append(free.pop(hit[0])[0] if hit else None)
                hows.append(hit and hit[1])
            ends.append(ends[-1] + n)
            at += m
        found = pa.StructArray.from_arrays([pa.array(places, pa.int32()), pa.array(hows, pa.string())], ["ref", "how"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found)

    # of one evaluation: a filter that the optimizer infers from a later explode does not match all once more
    matched = F.arrow_udf(match, "array<struct<ref int, how string>>").asNondeterministic()
    slim = lambda c: F.transform(c, lambda b: F.struct(b["text"].alias("text"), b["x"].alias("x"), b["y"].alias("y")))
    return rows.withColumn("matches", matched(slim("items"), slim("refs")))


def greedy_pairs(rows: DataFrame, key: str) -> DataFrame:
    """The pairs of ``greedy_pages``: key, item_id, ref_id, how."""
    pair = F.zip_with("items", "matches", lambda i, m: F.struct(i["item_id"].alias("item_id"), m["ref"].alias("ref"), m["how"].alias("how")))
    out = rows.select(key, "refs", F.inline(F.filter(pair, lambda p: p["ref"].isNotNull())))
    return out.select(key, "item_id", F.get("refs", F.col("ref"))["ref_id"].alias("ref_id"), "how")


def greedy_one_to_one(items: DataFrame, references: DataFrame, key: str, close_edits: int = 2, near_edits: int = 5, near_pixels: float = 50.0) -> DataFrame:
    """Each item, by id, takes the first free reference it matches: equal text, else at most
    ``close_edits`` apart, else within ``near_pixels`` and ``near_edits``. A reference is used once.

    items: key, item_id, text, x, y; references: key, ref_id, text, x, y. A page's boxes are matched together."""
    return greedy_pairs(greedy_pages(paged(items, references, key), close_edits, near_edits, near_pixels), key)


def interpolated(words: DataFrame, key: str) -> DataFrame:
    """Boxes for words without one, from the nearest words before and after that have one (x, y): the
    middle of both, else one step (``w``) beyond the one there is; a word with neither gets none.

    words: key, place, x, y, w (null where unmatched). Windows over the text's order, so a set-based
    reading of the replay in which new boxes are not seen by later words."""
    from pyspark.sql import Window as W

    before = W.partitionBy(key).orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    after = W.partitionBy(key).orderBy("place").rowsBetween(1, W.unboundedFollowing)
    box = F.when(F.col("x").isNotNull(), F.struct("x", "y", "w"))
    rows = words.withColumns({"p": F.last(box, ignorenulls=True).over(before), "n": F.first(box, ignorenulls=True).over(after)})
    p, n = F.col("p"), F.col("n")
    both = p.isNotNull() & n.isNotNull()
    x = F.when(both, (p["x"] + n["x"]) / 2.0).when(p.isNotNull(), (p["x"] + p["w"]).cast("double")).when(n.isNotNull(), (n["x"] - n["w"]).cast("double"))
    y = F.when(both, (p["y"] + n["y"]) / 2.0).otherwise(F.coalesce(p["y"], n["y"]).cast("double"))
    how = F.when(F.col("x").isNotNull(), "matched").when(both, "interpolated").when(p.isNotNull() | n.isNotNull(), "extrapolated").otherwise("missing")
    return rows.select(key, "place", F.coalesce(F.col("x").cast("double"), x).alias("x"), F.coalesce(F.col("y").cast("double"), y).alias("y"), how.alias("how"))


def folded_edits(edits: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Boxes left after an ordered edit log (op, box, old): add appends, modify replaces the first equal
    box, delete removes all equal ones. The fold stays in the JVM."""
    log = F.array_sort(F.collect_list(F.struct(*order, "op", "box", "old")))
    start = F.array().cast("array<string>")

    def step(boxes, e):
        at = F.array_position(boxes, e["old"])
        changed = F.when(at > 0, F.concat(F.slice(boxes, F.lit(1), (at - 1).cast("int")), F.array(e["box"]), F.slice(boxes, (at + 1).cast("int"), F.size(boxes)))).otherwise(boxes)
        return F.when(e["op"] == "add", F.concat(boxes, F.array(e["box"]))).when(e["op"] == "modify", changed).when(e["op"] == "delete", F.array_remove(boxes, e["old"])).otherwise(boxes)

    return edits.groupBy(key).agg(F.aggregate(log, start, step).alias("boxes"))


def collapsed_changes(edits: DataFrame, key: str, item: str, order: list[str]) -> DataFrame:
    """Net change of each item: add then modify is an add, add then delete is nothing, else the last."""
    ops = F.transform(F.array_sort(F.collect_list(F.struct(*order, "op"))), lambda e: e["op"])
    rows = edits.groupBy(key, item).agg(ops.alias("ops"))
    first, last = F.element_at("ops", 1), F.element_at("ops", -1)
    net = F.when((first == "add") & (last == "delete"), F.lit(None)).when((first == "add") & (last == "modify"), F.lit("add")).otherwise(last)
    return rows.withColumn("net", net).where("net is not null").select(key, item, "net")
