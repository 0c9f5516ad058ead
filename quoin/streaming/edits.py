"""An engine extra: the edit log as a stream, a page's boxes kept as state."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame


def apply_edit(boxes: list[str], op: str, box: str | None, old: str | None) -> list[str]:
    """add appends, modify replaces the first equal box, delete removes all equal ones."""
    if op == "add":
        return [*boxes, box]
    if op == "modify" and old in boxes:
        k = boxes.index(old)
        return [*boxes[:k], box, *boxes[k + 1 :]]
    if op == "delete":
        return [b for b in boxes if b != old]
    return boxes


def live_boxes(edits: DataFrame, key: str = "result_id") -> DataFrame:
    """Streaming ``edits`` (key, at, op, box, old): after each batch the boxes of every page it touched,
    joined by commas. Edits of a batch apply by ``at``; state is a page's list."""

    def update(name, batches, state):
        boxes = list(state.get[0]) if state.exists else []
        rows = sorted((r for pdf in batches for r in pdf[["at", "op", "box", "old"]].itertuples(index=False)), key=lambda r: r.at)
        for r in rows:
            boxes = apply_edit(boxes, r.op, r.box, r.old)
        state.update((boxes,))
        yield pd.DataFrame({key: [name[0]], "n": [len(boxes)], "boxes": [",".join(boxes)]})

    return edits.groupBy(key).applyInPandasWithState(update, f"{key} long, n long, boxes string", "boxes array<string>", "update", "NoTimeout")
