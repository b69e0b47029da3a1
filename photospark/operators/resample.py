"""Separable cubic resampling of tiled photos to any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photospark.functions.color import LUMA
from photospark.operators.features import RGB, propose_recipe

BITS = 22  # weights are integers of this many fraction bits, so every order of addition gives the same code


def cubic_weights(size: int, target: int):
    """(first, weights): per target position the first source position and its integer weights.

    The cubic kernel with a = -1/2 is widened by the scale when the photo shrinks and normalised inside the photo; positions
    beyond a position's support have weight 0.
    """
    import numpy as np

    scale = size / target
    wide = max(scale, 1.0)
    center = (np.arange(target) + 0.5) * scale
    first = np.maximum((center - 2 * wide + 0.5).astype(int), 0)
    last = np.minimum((center + 2 * wide + 0.5).astype(int), size)
    at = first[:, None] + np.arange((last - first).max())
    t = np.abs((at - center[:, None] + 0.5) / wide)
    kernel = np.where(t < 1, (1.5 * t - 2.5) * t * t + 1, np.where(t < 2, ((-0.5 * t + 2.5) * t - 4) * t + 2, 0.0))
    kernel = np.where(at < last[:, None], kernel, 0.0)
    kernel /= kernel.sum(axis=1, keepdims=True)
    return first, np.where(kernel < 0, np.ceil(kernel * 2 ** BITS - 0.5), np.floor(kernel * 2 ** BITS + 0.5)).astype(np.int64)


def _dense(size: int, target: int):
    """The weights as a (target, size) matrix of one photo size."""
    import numpy as np

    first, weights = cubic_weights(size, target)
    out = np.zeros((target, size + weights.shape[1]), dtype=np.int64)
    out[np.arange(target)[:, None], first[:, None] + np.arange(weights.shape[1])] = weights
    return out[:, :size]


def _rounded(sums):
    import numpy as np

    return np.clip((sums + (1 << (BITS - 1))) >> BITS, 0, 255)


def gathered(tiles: DataFrame, height: int, width: int, use, schema: str) -> DataFrame:
    """One ``use(photo, codes)`` record batch per photo, its resampled codes a (3, height, width) array.

    The first axis is resampled where a tile is read. A tile as wide as its photo yields codes there, one byte each; other tiles
    yield the sums of the target columns they touch, 4 bytes each (no sum reaches 2^31), which are added to those of the tiles
    beside them. The task that gathers a photo holds ``width`` such values per photo row; no pixel is a row of its own.
    """
    def across(batches):
        import functools

        import numpy as np
        import pyarrow as pa

        weights = functools.lru_cache(maxsize=16)(_dense)
        for batch in batches:
            place = batch.select(["x0", "rows", "cols", "w"]).to_pydict()
            firsts, packed = [], []
            for x0, rows, cols, w, px in zip(*place.values(), batch.column("px")):
                codes = px.values.to_numpy(zero_copy_only=False).astype(np.int64).reshape(rows, cols)
                part = weights(w, width)[:, x0:x0 + cols]
                xs = np.flatnonzero(part.any(axis=1))
                lo, hi = (0, width) if cols == w else (xs[0], xs[-1] + 1) if len(xs) else (0, 0)
                sums = np.stack([((codes >> shift) & 255) @ part[lo:hi].T for shift in (16, 8, 0)])
                firsts.append(-1 if cols == w else int(lo))
                packed.append((_rounded(sums).astype(np.uint8) if cols == w else sums.astype(np.int32)).tobytes())
            kept = [batch.column(c) for c in ("photo", "h", "y0", "rows")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(firsts, pa.int32()), pa.array(packed, pa.binary())], names=["photo", "h", "y0", "rows", "first", "part"])

    def down(batches):
        import functools

        import numpy as np

        weights = functools.lru_cache(maxsize=16)(_dense)
        for batch in batches:
            place = batch.select(["photo", "h"]).to_pydict()
            for photo, h, parts in zip(*place.values(), batch.column("parts")):
                parts = [p.as_py() for p in parts]
                wide = np.zeros((3, h, width), dtype=np.uint8 if all(p["first"] < 0 for p in parts) else np.int64)
                for p in parts:
                    rows = slice(p["y0"], p["y0"] + p["rows"])
                    if p["first"] < 0:
                        wide[:, rows] = np.frombuffer(p["part"], dtype=np.uint8).reshape(3, p["rows"], width)
                    else:
                        sums = np.frombuffer(p["part"], dtype=np.int32).reshape(3, p["rows"], -1)
                        wide[:, rows, p["first"]:p["first"] + sums.shape[2]] += sums
                codes = wide if wide.dtype == np.uint8 else _rounded(wide)
                # sums stay under 2^53, so products in doubles are exact
                yield use(photo, _rounded((weights(h, height).astype(np.float64) @ codes.astype(np.float64)).astype(np.int64)))

    kind = tiles.schema["photo"].dataType.simpleString()
    kept = ", ".join(f"{c} {tiles.schema[c].dataType.simpleString()}" for c in ("photo", "h", "y0", "rows"))
    parts = tiles.select("photo", "y0", "x0", "rows", "cols", "h", "w", "px").mapInArrow(across, f"{kept}, first int, part binary")
    whole = parts.groupBy("photo", "h").agg(F.collect_list(F.struct("y0", "rows", "first", "part")).alias("parts"))
    return whole.mapInArrow(down, f"photo {kind}, {schema}")


def resize_tiles(tiles: DataFrame, height: int = 128, width: int = 128) -> DataFrame:
    """Tiles to pixel rows (photo, y, x, r, g, b) of photos resampled to ``height`` x ``width``; works for any size and ratio."""
    def rows(photo, codes):
        import numpy as np
        import pyarrow as pa

        ys, xs = (a.ravel().astype(np.int32) for a in np.mgrid[:height, :width])
        columns = [np.full(height * width, photo), ys, xs, *codes.reshape(3, -1).astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["photo", "y", "x", *RGB])

    return gathered(tiles, height, width, rows, "y int, x int, r int, g int, b int")


def recipe_tiles(tiles: DataFrame, height: int = 128, width: int = 128) -> DataFrame:
    """``features.select_recipe`` of photos resampled to ``height`` x ``width``; the percentiles are read where the photo is resampled."""
    def rank(photo, codes):
        import numpy as np
        import pyarrow as pa

        unit = np.arange(256) / 255
        linear = np.where(unit <= 0.04045, unit / 12.92, ((unit + 0.055) / 1.055) ** 2.4)
        r, g, b = linear[codes.reshape(3, -1)]
        median, p95 = np.percentile(r * LUMA[0] + g * LUMA[1] + b * LUMA[2], [50, 95])
        return pa.RecordBatch.from_pydict({"photo": pa.array(np.full(1, photo)), "median": [median], "p95": [p95]})

    return propose_recipe(gathered(tiles, height, width, rank, "median double, p95 double"))
