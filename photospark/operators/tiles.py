"""Photos as array-valued tiles: settings and a second version are joined per tile, maps and partial sums run where a tile is read.

A tile is a row (photo, y0, x0, rows, cols, h, w, px): its place and size, the size of the whole photo and the 24-bit codes
of its pixels row by row. Pixel rows come into being inside the task that uses them, so no exchange ever carries them;
what is shuffled are tiles (one int per pixel) and per-photo sums. A result that is needed twice is computed again from the
tiles: the maps are cheap, a shuffle of pixel rows isn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photospark.contract import require
from photospark.operators import adjust as A
from photospark.operators import features as E
from photospark.operators.features import RGB

PLACE = ("photo", "y0", "x0")
LAYOUT = ("y0", "x0", "rows", "cols")


def code(r: Column, g: Column, b: Column) -> Column:
    """One int for three 8-bit channels."""
    return (r * 65536 + g * 256 + b).cast("int")


def channel(value: Column, i: int) -> Column:
    """Channel 0, 1 or 2 of a 24-bit code."""
    return F.shiftright(value, 16 - 8 * i).bitwiseAND(255)


def cut_tiles(pixels: DataFrame, rows: int = 128, cols: int = 512) -> DataFrame:
    """Pixel rows to tiles of at most ``rows`` x ``cols`` pixels; the one place where pixel rows are grouped."""
    y0, x0 = (F.floor(F.col(a) / n) * n for a, n in (("y", rows), ("x", cols)))
    spots = E.with_dims(pixels).select("photo", "h", "w", y0.cast("int").alias("y0"), x0.cast("int").alias("x0"), F.struct("y", "x", code(*[F.col(c) for c in RGB]).alias("c")).alias("p"))
    tiles = spots.groupBy(*PLACE, "h", "w").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    return tiles.select(*PLACE, F.least(F.lit(rows), F.col("h") - F.col("y0")).cast("int").alias("rows"), F.least(F.lit(cols), F.col("w") - F.col("x0")).cast("int").alias("cols"),
                        "h", "w", F.transform("ps", lambda p: p["c"]).alias("px"))


def from_binary(tiles: DataFrame) -> DataFrame:
    """Stored tiles (photo, y0, x0, rows, cols, h, w, rgb bytes) to array tiles, in the task that reads them."""
    def read(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            packed = [np.frombuffer(b.as_py(), dtype=np.uint8).reshape(-1, 3) @ np.array([65536, 256, 1], dtype=np.int32) for b in batch.column("rgb")]
            px = pa.array(packed, type=pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], px], names=[*names, "px"])

    names = [*PLACE, "rows", "cols", "h", "w"]
    kinds = ", ".join(f"{c} {tiles.schema[c].dataType.simpleString()}" for c in names)
    return tiles.select(*names, "rgb").mapInArrow(read, f"{kinds}, px array<int>")


def with_second(tiles: DataFrame, other: DataFrame, name: str = "adj") -> DataFrame:
    """Attach the codes of a second version tile by tile; a tile cut differently fails the job."""
    second = other.select(*PLACE, F.col("cols").alias("_cols"), F.col("px").alias(name))
    joined = tiles.join(second, list(PLACE))
    return require(joined, (F.col("cols") == F.col("_cols")) & (F.size("px") == F.size(name)), "the two versions are cut differently").drop("_cols")


def with_settings(tiles: DataFrame, *settings: DataFrame) -> DataFrame:
    """Attach per-photo settings; tiles of photos without settings go, as in the pixel form."""
    for table in settings:
        tiles = tiles.join(table, "photo")
    return tiles


def pixels_of(tiles: DataFrame, **versions: str) -> DataFrame:
    """Pixel rows (photo, y, x, h, w, r, g, b, ..) with every other column of the tile beside them, without an exchange.

    ``versions`` maps further code columns to the prefix of their channels, such as ``adj="adj_"``.
    """
    versions = {"px": "", **versions}
    kept = [c for c in tiles.columns if c not in LAYOUT and c not in versions]
    spread = tiles.select(*kept, *LAYOUT, F.posexplode(F.arrays_zip(*versions)).alias("_i", "_c"))
    y = (F.col("y0") + F.floor(F.col("_i") / F.col("cols"))).cast("int")
    x = (F.col("x0") + F.pmod("_i", "cols")).cast("int")
    channels = [channel(F.col("_c")[v], i).alias(p + c) for v, p in versions.items() for i, c in enumerate(RGB)]
    return spread.select(*kept, y.alias("y"), x.alias("x"), *channels)


# ---------------------------------------------------------------- jobs on tiles


def protect_tiles(tiles: DataFrame, caps: DataFrame | None = None, edge: int | None = None) -> DataFrame:
    """Protected color of tiles (px, adj): settings from one pass, the map in a second, both where the tiles are read."""
    both = pixels_of(tiles, adj="adj_")
    settings = E.natural_settings(both if edge is None else E.sample_grid(both, edge)).select("photo", "color_strength", "tone_lift")
    if caps is not None:
        settings = A.capped(settings, caps)
    return A.protect_color(pixels_of(with_settings(tiles, settings), adj="adj_"))


def natural_adjust_tiles(tiles: DataFrame, limits: DataFrame, edge: int = 256) -> tuple[DataFrame, DataFrame]:
    """``adjust.natural_adjust`` on tiles (px, adj): (pixels, report per photo).

    One pass measures the photo, one runs the maps into the guard's sums, one runs them again for the pixels. Photos, not
    pixels, are joined between them.
    """
    found = E.adjust_settings(E.sample_grid(pixels_of(tiles, adj="adj_"), edge))
    ready = A.capped(found.select("photo", "color_strength", "tone_lift"), limits).join(
        found.select("photo", "suggested_strength"), "photo").join(limits.select("photo", "shadow_strength"), "photo").select(
        "photo", "color_strength", "tone_lift", F.least("suggested_strength", "shadow_strength").alias("strength"))

    def mapped(table: DataFrame, *carried: str) -> DataFrame:
        based = A.protect_color(pixels_of(table, adj="adj_"), keep=("strength", *carried))
        return A.lift_shadows(A.as_source(based, "strength", *carried))

    report = A.natural_report(mapped(with_settings(tiles, ready)), ready.select("photo", "strength"))
    judged = with_settings(tiles, ready, report.select("photo", "applied"))
    return A.kept_pixels(mapped(judged, "applied")), report


def lut3d_tiles(tiles: DataFrame, bases: DataFrame, weights: DataFrame, nodes: int = 33, count: int = 3) -> DataFrame:
    """Trilinear lookup in the weighted sum of basis tables: (photo, y, x, r, g, b, out_r, out_g, out_b).

    ``bases``: nodes^3 rows (ri, gi, bi, v) with v = array of ``count`` channel triples, ``weights``: (photo, weights array).
    The table's size is fixed by its format (65 nodes at most); it goes to every task once as one array and is
    indexed there, corner by corner, for a whole tile at a time. A table that lacks a node or repeats one is refused.
    """
    import numpy as np

    if nodes > 65:
        raise ValueError("lookup table above its format")
    listed = bases.select("ri", "gi", "bi", "v").limit(nodes ** 3 + 1).collect()
    table = np.full((nodes, nodes, nodes, count, 3), np.nan)
    for row in listed:
        table[row["ri"], row["gi"], row["bi"]] = row["v"]
    if len(listed) != nodes ** 3 or np.isnan(table).any():
        raise ValueError("a lookup table needs every node once")
    shared = tiles.sparkSession.sparkContext.broadcast(table.reshape(-1, count, 3))

    def look_up(batches):
        import pyarrow as pa

        nodes_of = shared.value
        for batch in batches:
            tile = batch.select(["photo", "y0", "x0", "cols", "weights"]).to_pydict()
            for photo, y0, x0, cols, share, px in zip(*tile.values(), batch.column("px")):
                codes = px.values.to_numpy(zero_copy_only=False).astype(np.int64)
                at = np.arange(len(codes))
                rgb = [codes >> 16, (codes >> 8) & 255, codes & 255]
                spots = [np.minimum(c / 255 / 1.0001 * (nodes - 1), float(nodes - 1)) for c in rgb]
                low = [np.minimum(np.floor(s), nodes - 1).astype(np.int64) for s in spots]
                mixed = np.zeros((len(codes), 3))
                for corner in range(8):
                    node, part = np.zeros(len(codes), dtype=np.int64), np.ones(len(codes))
                    for k in range(3):
                        up = (corner >> k) & 1
                        node = node * nodes + np.minimum(low[k] + up, nodes - 1)
                        inside = spots[k] - low[k]
                        part = part * (inside if up else 1.0 - inside)
                    value = sum((share[k] * nodes_of[node, k] for k in range(1, count)), share[0] * nodes_of[node, 0])
                    mixed += value * part[:, None]
                out = np.floor(np.clip(mixed * 255 + 0.5, 0, 255)).astype(np.int32)
                columns = [np.full(len(codes), photo), (y0 + at // cols).astype(np.int32), (x0 + at % cols).astype(np.int32), *[c.astype(np.int32) for c in rgb], *out.T]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["photo", "y", "x", *RGB, *["out_" + c for c in RGB]])

    kind = tiles.schema["photo"].dataType.simpleString()
    schema = f"photo {kind}, y int, x int, r int, g int, b int, out_r int, out_g int, out_b int"
    return with_settings(tiles, weights.select("photo", "weights")).select("photo", "y0", "x0", "cols", "px", "weights").mapInArrow(look_up, schema)


# ---------------------------------------------------------------- tiles with borders


def with_halo(tiles: DataFrame, names: tuple[str, ...] = ("px",), rows: int = 128, cols: int = 512) -> DataFrame:
    """Attach ``halo``: for every neighbour (side 0 to 8, row by row, 4 the tile itself) the codes that touch the tile, per version.

    Each tile sends its edge rows, edge columns and corners to its neighbours, so one shuffle carries the edges of the
    tiles. ``rows`` and ``cols`` are the pitch of the cut; a tile off the grid fails the job.
    """
    on_grid = (F.col("y0") % rows == 0) & (F.col("x0") % cols == 0) & (F.col("rows") == F.least(F.lit(rows), F.col("h") - F.col("y0"))) & (
        F.col("cols") == F.least(F.lit(cols), F.col("w") - F.col("x0")))
    tiles = require(tiles, on_grid, "tiles don't follow the pitch")
    # one generated row computes derived codes once, not once per pixel of an edge
    once = F.explode(F.array(F.struct(*names))).alias("_v")
    tiles = tiles.select(*[c for c in tiles.columns if c not in names], once).select("*", "_v.*").drop("_v")

    def part(name: str, dy: int, dx: int) -> Column:
        ys = {-1: F.array(F.lit(0)), 1: F.array(F.col("rows") - 1), 0: F.sequence(F.lit(0), F.col("rows") - 1)}[dy]
        xs = {-1: F.array(F.lit(0)), 1: F.array(F.col("cols") - 1), 0: F.sequence(F.lit(0), F.col("cols") - 1)}[dx]
        return F.flatten(F.transform(ys, lambda y: F.transform(xs, lambda x: F.get(name, (y * F.col("cols") + x).cast("int")))))

    sent = []
    for dy in (-1, 0, 1):
        for dx in (-1, 0, 1):
            if (dy, dx) != (0, 0):
                sent.append(F.struct((F.col("y0") + dy * rows).alias("y0"), (F.col("x0") + dx * cols).alias("x0"), F.lit((1 - dy) * 3 + 1 - dx).alias("side"),
                                     F.array(*[part(n, dy, dx) for n in names]).alias("codes")))
    inside = (F.col("_m.y0") >= 0) & (F.col("_m.x0") >= 0) & (F.col("_m.y0") < F.col("h")) & (F.col("_m.x0") < F.col("w"))
    edges = tiles.select("photo", "h", "w", F.explode(F.array(*sent)).alias("_m")).where(inside).select("photo", "_m.*")
    halo = edges.groupBy(*PLACE).agg(F.map_from_entries(F.collect_list(F.struct("side", "codes"))).alias("halo"))
    return tiles.join(halo, list(PLACE), "left")


def _padded(codes, halo: dict, which: int, rows: int, cols: int):
    """Codes of a tile with a border of one: the neighbours' pixels, at the photo's edge the nearest pixel."""
    import numpy as np

    out = np.zeros((rows + 2, cols + 2), dtype=np.int64)
    out[1:-1, 1:-1] = codes.reshape(rows, cols)
    for side, at, near in ((3, 0, 1), (5, -1, -2)):
        out[1:-1, at] = halo[side][which] if side in halo else out[1:-1, near]
    for row, at, near in ((0, 0, 1), (6, -1, -2)):
        if row + 1 not in halo:
            out[at] = out[near]
            continue
        out[at, 1:-1] = halo[row + 1][which]
        for side, x, inner in ((row, 0, 1), (row + 2, -1, -2)):
            out[at, x] = halo[side][which][0] if side in halo else out[at, inner]
    return out


def _channels(padded):
    import numpy as np

    return np.stack([padded >> 16, (padded >> 8) & 255, padded & 255])


def _each_tile(batch, names):
    """(photo, y0, x0, padded codes per version) of a batch of tiles with halos."""
    place = batch.select(["photo", "y0", "x0", "rows", "cols", "halo"]).to_pydict()
    codes = [batch.column(n) for n in names]
    for i, (photo, y0, x0, rows, cols, halo) in enumerate(zip(*place.values())):
        around = dict(halo or [])
        yield photo, y0, x0, [_padded(c[i].values.to_numpy(zero_copy_only=False), around, k, rows, cols) for k, c in enumerate(codes)]


def gradients_tiles(tiles: DataFrame, rows: int = 128, cols: int = 512) -> DataFrame:
    """(photo, y, x, dx_r .. dy_b): differences to the previous pixel along x and y, null at the photo's edge."""
    def differ(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for photo, y0, x0, (padded,) in _each_tile(batch, ("px",)):
                value = _channels(padded)
                inner = value[:, 1:-1, 1:-1]
                high, wide = inner.shape[1:]
                ys, xs = (a.ravel() for a in np.mgrid[y0:y0 + high, x0:x0 + wide])
                steps = [(inner - value[:, 1:-1, :-2], xs == 0), (inner - value[:, :-2, 1:-1], ys == 0)]
                columns = [pa.array(d[i].ravel().astype(np.int32), mask=edge) for d, edge in steps for i in range(3)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(high * wide, photo)), pa.array(ys.astype(np.int32)), pa.array(xs.astype(np.int32)), *columns], names=names)

    names = ["photo", "y", "x", *[f"d{a}_{c}" for a in "xy" for c in RGB]]
    kind = tiles.schema["photo"].dataType.simpleString()
    schema = ", ".join([f"photo {kind}", *[f"{n} int" for n in names[1:]]])
    return with_halo(tiles, ("px",), rows, cols).select(*LAYOUT, "photo", "px", "halo").mapInArrow(differ, schema)


def native_metrics_tiles(tiles: DataFrame, rows: int = 128, cols: int = 512) -> DataFrame:
    """``features.native_metrics`` of tiles with three versions: px (source), out and ref.

    Every tile yields one row of sums, computed with its border; the sums of a photo are added up.
    """
    sums = ("n", "square", "mean", "full", "chroma", "dx", "nx", "dy", "ny", "dark", "ndark")

    def measure(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        from photospark.functions.color import LUMA

        weight = np.array(LUMA)[:, None, None]
        for batch in batches:
            found = []
            for photo, y0, x0, versions in _each_tile(batch, ("px", "out", "ref")):
                source, out, ref = (_channels(v) for v in versions)
                core = np.s_[:, 1:-1, 1:-1]
                a, b, peak = out[core] / 255, ref[core] / 255, source[core].max(axis=0)
                la, lb = (out / 255 * weight).sum(axis=0), (ref / 255 * weight).sum(axis=0)
                ca, cb = la[1:-1, 1:-1], lb[1:-1, 1:-1]
                apart = la - lb
                across, down = np.abs(apart[1:-1, 1:-1] - apart[1:-1, :-2]), np.abs(apart[1:-1, 1:-1] - apart[:-2, 1:-1])
                across, down = across[:, 1 if x0 == 0 else 0:], down[1 if y0 == 0 else 0:]
                high, wide = ca.shape
                near = np.stack([out[:, i:i + high, j:j + wide] for i in range(3) for j in range(3)])
                residual = np.abs(out[core] - np.median(near, axis=0)).sum(axis=0) / 3
                dark = (peak > 0) & (peak <= 16)
                found.append((photo, ca.size, ((a - b) ** 2).sum() / 3, a.sum() / 3, ((out[core].max(axis=0) == 255) & (peak < 255)).sum(),
                              (((a - ca) - (b - cb)) ** 2).sum() / 3, across.sum(), across.size, down.sum(), down.size, residual[dark].sum(), dark.sum()))
            frame = pd.DataFrame(found, columns=["photo", *sums])
            yield pa.RecordBatch.from_pandas(frame.astype({c: "float64" for c in sums}), preserve_index=False)

    kind = tiles.schema["photo"].dataType.simpleString()
    measured = with_halo(tiles, ("px", "out", "ref"), rows, cols).select(*LAYOUT, "photo", "px", "out", "ref", "halo").mapInArrow(
        measure, ", ".join([f"photo {kind}", *[f"{c} double" for c in sums]]))
    total = measured.groupBy("photo").agg(*[F.sum(c).alias(c) for c in sums])
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return total.select(
        "photo", share("square", "n").alias("mse"), share("mean", "n").alias("mean_rgb"), share("full", "n").alias("new_full_channel_fraction"),
        E.psnr(F.col("square") / F.col("n")).alias("psnr_db"), share("chroma", "n").alias("chroma_mse"),
        ((share("dy", "ny") + share("dx", "nx")) / 2).alias("luma_gradient_l1"), share("dark", "ndark").alias("dark_median_residual_codes"))
