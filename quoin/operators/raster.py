"""Lines and rooms from pixels. Run detection is set-based on a pixel table; rooms are labelled per image."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

INK, EVERY, LEAST, WALL = 128, 2, 50, 100
SLICE, REMEMBERED = 64, 32 << 20  # images unpacked at a time; bytes of images and rooms remembered


def preprocessed(red: Column, green: Column, blue: Column, limit: int = 200) -> Column:
    """Ink (0) or paper (255): the grey value at full contrast, which leaves only both ends, against ``limit``."""
    grey = F.floor(red * 0.2126 + green * 0.7152 + blue * 0.0722)
    return F.when(F.when(grey > 127, 255).otherwise(0) >= limit, 255).otherwise(0)


def line_runs(pixels: DataFrame, least: int = LEAST) -> DataFrame:
    """Runs of ink (v < 128) of at least ``least`` pixels in every second row and column of pixels
    (image_id, x, y, v), as gaps and islands: along a run, place minus row number is constant."""

    def runs(along: str, across: str, kind: str) -> DataFrame:
        ink = pixels.where((F.col("v") < INK) & (F.col(across) % EVERY == 0))
        island = F.col(along) - F.row_number().over(W.partitionBy("image_id", across).orderBy(along))
        rows = ink.withColumn("island", island).groupBy("image_id", across, "island")
        rows = rows.agg(F.min(along).alias("first"), F.max(along).alias("last")).where(F.col("last") - F.col("first") + 1 >= least)
        return rows.select("image_id", F.lit(kind).alias("orientation"), F.col(across).alias("at"), "first", "last", (F.col("last") - F.col("first") + 1).alias("length"))

    return runs("x", "y", "horizontal").unionByName(runs("y", "x", "vertical"))


def walls(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("length") >= WALL)


def thickness(lines: DataFrame, gap: int = 30, overlap: int = 25) -> DataFrame:
    """Lines with a thickness, as a replay in order (horizontal first, then ``at`` and ``first``): a line that has
    none yet looks at all later ones of its orientation that overlap it by more than ``overlap``; each
    nearer than ``gap`` gives both their distance, so the last one counts; a line without any gets 1.
    Images go to tasks by hash, many to a task."""
    names = ["image_id", "orientation", "at", "first", "last", "length"]

    def replay(table: pa.Table) -> pa.Table:
        table = table.select(names).sort_by([(c, "ascending") for c in names[:4]]).combine_chunks()
        image, at, first, last = (table.column(c).to_numpy() for c in ("image_id", "at", "first", "last"))
        across = np.array([o == "horizontal" for o in table.column("orientation").to_pylist()], bool)
        new = np.ones(len(at), bool)
        new[1:] = (image[1:] != image[:-1]) | (across[1:] != across[:-1])
        starts = np.flatnonzero(new)
        out = np.full(len(at), -1, np.int64)
        for start, end in zip(starts, [*starts[1:], len(at)]):
            for i in range(start, end):
                if out[i] >= 0:
                    continue
                far = at[i + 1 : end] - at[i]
                j = int(np.searchsorted(far, gap, "left"))  # lines stand in the order of ``at``
                hit = np.flatnonzero(np.minimum(last[i + 1 : i + 1 + j], last[i]) - np.maximum(first[i + 1 : i + 1 + j], first[i]) > overlap)
                out[i + 1 + hit] = far[hit]
                out[i] = far[hit[-1]] if len(hit) else 1
        return table.append_column("thickness", pa.array(out))

    n = 4 * int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = lines.select("image_id", "orientation", *[F.col(c).cast("long").alias(c) for c in names[2:]], F.pmod(F.xxhash64("image_id"), F.lit(n)).alias("bucket"))
    return rows.groupBy("bucket").applyInArrow(replay, "image_id long, orientation string, at long, first long, last long, length long, thickness long")


def perimeter(lines: DataFrame, inset: int = 10) -> DataFrame:
    """The lines' bounding box, drawn in by ``inset``."""
    across = F.col("orientation") == "horizontal"
    x1, x2 = F.when(across, F.col("first")).otherwise(F.col("at")), F.when(across, F.col("last")).otherwise(F.col("at"))
    y1, y2 = F.when(across, F.col("at")).otherwise(F.col("first")), F.when(across, F.col("at")).otherwise(F.col("last"))
    return lines.groupBy("image_id").agg((F.min(x1) + inset).alias("x1"), (F.min(y1) + inset).alias("y1"), (F.max(x2) - inset).alias("x2"), (F.max(y2) - inset).alias("y2"))


def simplified(points: np.ndarray, tolerance: float = 5.0) -> np.ndarray:
    """Douglas-Peucker, with a stack."""
    keep = np.zeros(len(points), bool)
    keep[[0, -1]] = True
    todo = [(0, len(points) - 1)]
    while todo:
        i, j = todo.pop()
        if j <= i + 1:
            continue
        a, d = points[i], points[j] - points[i]
        rest = points[i + 1 : j] - a
        n = np.hypot(*d)
        far = np.abs(d[0] * rest[:, 1] - d[1] * rest[:, 0]) / n if n else np.hypot(rest[:, 0], rest[:, 1])
        k = int(far.argmax())
        if far[k] > tolerance:
            keep[i + 1 + k] = True
            todo += [(i, i + 1 + k), (i + 1 + k, j)]
    return points[keep]


def contour(mask: np.ndarray, tolerance: float = 5.0) -> np.ndarray:
    """Vertices (x, y) around a region: from its topmost, then leftmost pixel on to the first neighbour
    (clockwise from the right) that lies on its edge and was not met; then simplified. A trace of fewer
    than four points, or of fewer than three once simplified, gives the region's rectangle."""
    h, w = mask.shape
    padded = np.zeros((h + 2, w + 2), bool)
    padded[1:-1, 1:-1] = mask
    inner = np.ones((h, w), bool)
    for dy in (0, 1, 2):
        for dx in (0, 1, 2):
            inner &= padded[dy : dy + h, dx : dx + w]
    ys, xs = np.nonzero(mask & ~inner)
    left = set(zip(xs.tolist(), ys.tolist()))
    at = (int(xs[0]), int(ys[0]))
    path = [at]
    left.discard(at)
    while True:
        step = next((p for dx, dy in ((1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)) if (p := (at[0] + dx, at[1] + dy)) in left), None)
        if step is None:
            break
        at = step
        path.append(at)
        left.discard(at)
    yy, xx = np.nonzero(mask)
    box = np.array([(xx.min(), yy.min()), (xx.max(), yy.min()), (xx.max(), yy.max()), (xx.min(), yy.max())])
    if len(path) < 4:
        return box
    points = simplified(np.array(path), tolerance)
    return points if len(points) >= 3 else box


def regions(grid: np.ndarray, seed_step: int = 10, cap: int = 100_000):
    """Light regions (4-connected) in the order of their first seed, as masks. Pixels are labelled by runs, which are
    joined where they touch; only a region of more than ``cap`` pixels is walked pixel by pixel, as it stops
    there and its rest may be a region again."""
    light = grid > INK
    h, w = grid.shape
    edge = np.diff(np.pad(light, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    rows, starts = np.nonzero(edge == 1)
    ends = np.nonzero(edge == -1)[1]
    by_row = np.searchsorted(rows, np.arange(h + 1))
    up = list(range(len(rows)))

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for y in range(1, h):
        i, j = by_row[y - 1], by_row[y]
        while i < by_row[y] and j < by_row[y + 1]:
            if starts[i] < ends[j] and starts[j] < ends[i]:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
            if ends[i] < ends[j]:
                i += 1
            else:
                j += 1
    label = np.zeros(h * w + 1, np.int64)
    names = np.array([root(x) + 1 for x in range(len(rows))], np.int64)
    np.add.at(label, rows * w + starts, names)
    np.add.at(label, rows * w + ends, -names)
    label = np.cumsum(label)[:-1].reshape(h, w)
    size = np.bincount(label.ravel(), minlength=len(rows) + 1)
    seen = np.zeros(grid.shape, bool)
    for y0 in range(seed_step, h - seed_step, seed_step):
        for x0 in range(seed_step, w - seed_step, seed_step):
            if seen[y0, x0] or not light[y0, x0]:
                continue
            if size[label[y0, x0]] <= cap:
                mask = label == label[y0, x0]
            else:
                mask = _walked(light, seen, y0, x0, cap)
            seen |= mask
            yield mask


def _walked(light: np.ndarray, seen: np.ndarray, y0: int, x0: int, cap: int) -> np.ndarray:
    h, w = light.shape
    mask, stack, n = np.zeros(light.shape, bool), [(y0, x0)], 0
    while stack and n < cap:
        y, x = stack.pop()
        if seen[y, x] or mask[y, x]:
            continue
        mask[y, x] = True
        n += 1
        stack += [(v, u) for v, u in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)) if 0 <= v < h and 0 <= u < w and light[v, u] and not seen[v, u] and not mask[v, u]]
    return mask


def inside_polygon(x: float, y: float, polygon) -> bool:
    """Ray casting; fewer than three points hold everything."""
    if len(polygon) < 3:
        return True
    inside = False
    for (ax, ay), (bx, by) in zip(polygon, [polygon[-1], *polygon[:-1]]):
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def found_rooms(grid: np.ndarray, outline=(), least: int = 100, most_area: float = 0.4, most_side: float = 0.8) -> list[dict]:
    """Regions that are rooms: not like text (wide and small, or low and near the upper or lower edge), not small,
    not most of the image, and with their centre inside ``outline``."""
    h, w = grid.shape
    rooms = []
    for mask in regions(grid):
        ys, xs = np.nonzero(mask)
        n, x1, x2, y1, y2 = len(xs), int(xs.min()), int(xs.max()), int(ys.min()), int(ys.max())
        wide = (x2 - x1) / max(y2 - y1, 1)
        at_edge = (y1 < h * 0.1 or y2 > h * 0.9) and x2 - x1 < 200 and y2 - y1 < 40
        text = wide > 5 and n < 300 or at_edge
        if text or n < least or n > h * w * most_area or x2 - x1 > w * most_side or y2 - y1 > h * most_side:
            continue
        if not inside_polygon((x1 + x2) / 2, (y1 + y2) / 2, outline):
            continue
        rooms.append({"x1": x1, "y1": y1, "x2": x2, "y2": y2, "area": n, "points": contour(mask).ravel().tolist()})
    return rooms


ROOM = "image_id long, room long, x1 long, y1 long, x2 long, y2 long, area long, points array<long>"


def rooms(images: DataFrame, outlines: DataFrame | None = None) -> DataFrame:
    """Rooms of images (image_id, width, pixels by rows), numbered from 1 in the order they are found, with
    their vertices as flat numbers. outlines (image_id, x1, y1, x2, y2), if given, is the second pass: an
    image with an outline keeps the rooms whose centre lies in it. An image is one row, so nothing is
    shuffled but the outlines. A pixel crosses to Python as one bit (ink or light), which is all that regions
    are made of; equal images with equal outlines are searched once as long as they are remembered."""
    light = F.transform("pixels", lambda v: F.coalesce(v > INK, F.lit(False)))
    rows = images.select("image_id", F.col("width").cast("int").alias("width"), light.alias("light"))
    if outlines is None:
        rows = rows.withColumn("outline", F.array().cast("array<long>"))
    else:
        corners = F.array(*[F.col(c).cast("long") for c in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")])
        rows = rows.join(outlines.select("image_id", corners.alias("outline")), "image_id", "left")
    fields = [c.split() for c in ROOM.split(", ")]
    kinds = [pa.list_(pa.int64()) if k.startswith("array") else pa.int64() for _, k in fields]

    def find(batches):
        known: dict = {}
        held = 0
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch, out = whole.slice(at, SLICE), []
                lists = batch.column("light")
                pixels, ends = lists.flatten().to_numpy(zero_copy_only=False), np.cumsum([len(v) if v.is_valid else 0 for v in lists])
                for image, width, start, end, outline in zip(batch.column("image_id").to_pylist(), batch.column("width").to_pylist(), [0, *ends], ends, batch.column("outline").to_pylist()):
                    bits = np.packbits(pixels[start:end]).tobytes()
                    key = (width, end - start, bits, tuple(outline or ()))
                    if key not in known:
                        grid = pixels[start:end].reshape(-1, width).astype(np.uint8) * 255
                        found = found_rooms(grid, np.asarray(outline or ()).reshape(-1, 2).tolist()) if grid.size else []
                        held += len(bits) + sum(200 + 40 * len(r["points"]) for r in found)
                        if held > REMEMBERED:
                            known, held = {}, 0
                        known[key] = found
                    out += [{"image_id": image, "room": k, **room} for k, room in enumerate(known[key], 1)]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], k) for (c, _), k in zip(fields, kinds)], [c for c, _ in fields])

    return rows.mapInArrow(find, ROOM)
