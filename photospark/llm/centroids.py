"""Centroid clustering over Hilbert-ordered blocks of vectors with min/max boxes (zone maps)."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photospark.llm.stage import Stage

WIDTH, SCALE = 64, 64
#: Components are held within this, so that a squared distance is a 64-bit integer.
LIMIT = 1 << 20
AXES, BITS, BLOCK = 4, 15, 128
_BLOCK_SCHEMA = "ids array<{kind}>, n int, lo array<int>, hi array<int>, total array<long>, squares long, vectors binary"


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of rows of cell numbers (each below ``2**bits``; columns times bits at most 63)."""
    x = [c.astype(np.int64) for c in np.asarray(cells).T]
    for bit in range(bits - 1, 0, -1):
        high, low = np.int64(1 << bit), np.int64((1 << bit) - 1)
        for i, axis in enumerate(x):
            flip = (axis & high) != 0
            swap = np.where(flip, 0, (x[0] ^ axis) & low)
            x[i] = axis ^ swap
            x[0] = x[0] ^ np.where(flip, low, swap)
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn ^= np.where(x[-1] & np.int64(1 << bit), np.int64((1 << bit) - 1), 0)
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ turn) >> bit) & 1)
    return key


def usable(df: DataFrame, id_col: str, vector: str, width: int = WIDTH) -> DataFrame:
    """(id, v): the vectors of exactly ``width`` components without a null, NaN or infinite one, as doubles."""
    v = F.col(f"`{vector}`").cast("array<double>")
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return df.select(F.col(f"`{id_col}`").alias("id"), v.alias("v")).where(F.col("v").isNotNull() & (F.size("v") == width)).where(~odd)


def integers(column: pa.Array, width: int = WIDTH) -> np.ndarray:
    """Rows of floor(SCALE * x), held within LIMIT."""
    rows = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.clip(np.floor(rows * float(SCALE)), -LIMIT, LIMIT).astype(np.int64)


def main_axes(points: DataFrame, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(axes, low, high): the AXES directions of greatest variance and the range in which each is cut into cells.

    One pass; a task sends its count, sums and products (about ``width**2 / 2`` numbers). Only the order of the
    vectors depends on them, no result does.
    """
    upper = np.triu_indices(width)

    def moments(batches):
        n, total, products = 0, np.zeros(width), np.zeros((width, width))
        for batch in batches:
            x = integers(batch.column(0), width).astype(float)
            n, total, products = n + len(x), total + x.sum(0), products + x.T @ x
        if n:
            values = np.concatenate([[n], total, products[upper]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], names=["at", "value"])

    rows = points.select("v").mapInArrow(moments, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    size = 1 + width + len(upper[0])
    flat = np.zeros(size)
    flat[rows["at"].to_numpy()] = rows["value"].to_numpy()
    n = max(flat[0], 1.0)
    mean, spread = flat[1:width + 1] / n, np.zeros((width, width))
    spread[upper] = flat[width + 1:] / n
    spread = spread + np.triu(spread, 1).T - np.outer(mean, mean)
    value, axes = np.linalg.eigh(spread)
    axes, deviation = axes[:, ::-1][:, :AXES], np.sqrt(np.maximum(value[::-1][:AXES], 1e-12))
    centre = mean @ axes
    return axes, centre - 3 * deviation, centre + 3 * deviation


def blocks(points: DataFrame, stage: Stage, width: int = WIDTH) -> DataFrame:
    """Hilbert-ordered blocks of up to BLOCK vectors, written once: ids, count, box, sums and the packed vectors.

    The range partitions are cut by place and a random number, so a vector that fills a third of the table is
    spread over many tasks. Vectors are packed in the narrowest integers that hold the box.
    """
    axes, low, high = main_axes(points, width)
    kind = points.schema["id"].dataType.simpleString()

    def place(batches):
        for batch in batches:
            x = integers(batch.column(1), width)
            cells = np.clip((x @ axes - low) / (high - low) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
            packed = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer((np.arange(len(x) + 1) * 4 * width).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x, "<i4"))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hilbert(cells)), packed], names=["id", "place", "vector"])

    def gather(batches):
        for batch in batches:
            data = batch.column(1)
            if not len(data):
                continue
            x = np.frombuffer(b"".join(data.to_pylist()), "<i4").reshape(-1, width).astype(np.int64)
            out = {c: [] for c in ("ids", "n", "lo", "hi", "total", "squares", "vectors")}
            for at in range(0, len(x), BLOCK):
                part = x[at:at + BLOCK]
                lo, hi = part.min(0), part.max(0)
                most = int(max(-lo.min(), hi.max()))
                out["ids"].append(batch.column(0).slice(at, BLOCK)), out["n"].append(len(part))
                out["lo"].append(lo), out["hi"].append(hi), out["total"].append(part.sum(0)), out["squares"].append(int((part * part).sum()))
                out["vectors"].append(part.astype("<i1" if most < 128 else "<i2" if most < 32768 else "<i4").tobytes())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(out["n"])]), pa.int32()), pa.concat_arrays(out["ids"]))
            yield pa.RecordBatch.from_arrays(
                [lists, pa.array(out["n"], pa.int32()), pa.array(list(map(list, out["lo"])), pa.list_(pa.int32())), pa.array(list(map(list, out["hi"])), pa.list_(pa.int32())),
                 pa.array(list(map(list, out["total"])), pa.list_(pa.int64())), pa.array(out["squares"], pa.int64()), pa.array(out["vectors"], pa.binary())],
                names=list(out))

    keyed = points.mapInArrow(place, f"id {kind}, place long, vector binary").withColumn("salt", F.rand(11))
    ordered = keyed.repartitionByRange("place", "salt").sortWithinPartitions("place", "salt").select("id", "vector")
    return stage.write(ordered.mapInArrow(gather, _BLOCK_SCHEMA.format(kind=kind)), "blocks")


def candidates(lo: np.ndarray, hi: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Which centroids can be the nearest one (ties: the smallest number) of a vector inside each box.

    A centroid goes if its least distance to the box is above another's greatest, or if the difference of its
    distance and that of the centroid nearest to the middle of the box stays positive over the whole box.
    """
    c = centroids[None]
    low, high = lo[:, None], hi[:, None]
    least = (np.maximum(np.maximum(low - c, c - high), 0) ** 2).sum(-1)
    most = (np.maximum(np.abs(low - c), np.abs(high - c)) ** 2).sum(-1)
    kept = least <= most.min(1, keepdims=True)
    near = ((low + high - 2 * c) ** 2).sum(-1).argmin(1)
    rival = centroids[near][:, None]
    lean = c - rival
    lead = (rival ** 2).sum(-1) - (c ** 2).sum(-1) + 2 * np.where(lean > 0, lean * high, lean * low).sum(-1)
    number = np.arange(len(centroids))[None]
    beaten = (lead < 0) | ((lead == 0) & (near[:, None] < number))
    return kept & ~beaten


def assign(batch: pa.RecordBatch, centroids: np.ndarray):
    """For each block of a batch with lo, hi, n and vectors: (row, clusters or the only candidate, vectors)."""
    width = centroids.shape[1]
    at = {name: k for k, name in enumerate(batch.schema.names)}
    lists = [batch.column(at[c]).flatten().to_numpy().reshape(-1, width).astype(np.int64) for c in ("lo", "hi")]
    counts, packed = batch.column(at["n"]).to_numpy(), batch.column(at["vectors"])
    for first in range(0, batch.num_rows, 64):
        allowed = candidates(lists[0][first:first + 64], lists[1][first:first + 64], centroids)
        for k in range(len(allowed)):
            row, n = first + k, int(counts[first + k])
            raw = packed[row].as_py()
            x = np.frombuffer(raw, f"<i{len(raw) // (n * width)}").reshape(n, width)
            own = np.flatnonzero(allowed[k])
            yield row, (int(own[0]) if len(own) == 1 else own[distances(x, centroids[own]).argmin(1)]), x


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows; as doubles in one product, which hold every sum below 2**53."""
    x, c = x.astype(float), centroids.astype(float)
    return ((x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None]).astype(np.int64)


def sums(cut: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """(counts, sums, sums of squares) of the vectors of each centroid; a block with one candidate is taken by its sums.

    Tasks send one row per centroid, so the driver sees ``len(centroids)`` times the width numbers.
    """
    many, width = centroids.shape

    def add(batches):
        n, total, squares = np.zeros(many, np.int64), np.zeros((many, width), np.int64), [0] * many
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch.column(3).flatten().to_numpy().reshape(-1, width)
            for row, found, x in assign(batch, centroids):
                if isinstance(found, int):
                    n[found] += len(x)
                    total[found] += whole[row]
                    squares[found] += batch.column(4)[row].as_py()
                    continue
                for k in np.unique(found).tolist():
                    part = x[found == k].astype(np.int64)
                    n[k] += len(part)
                    total[k] += part.sum(0)
                    squares[k] += int((part * part).sum())
        live = np.flatnonzero(n)
        flat = np.concatenate([np.column_stack([n, total])[live], np.array([squares[k] for k in live], np.int64).reshape(-1, 1)], 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(live, width + 2).astype(np.int32)), pa.array(np.tile(np.arange(width + 2, dtype=np.int32), len(live))), pa.array(flat.ravel())], names=["cluster", "at", "value"])

    rows = cut.select("lo", "hi", "n", "total", "squares", "vectors").mapInArrow(add, "cluster int, at int, value long")
    got = np.zeros((many, width + 2), np.int64)
    for r in rows.groupBy("cluster", "at").agg(F.sum("value").alias("value")).collect():
        got[r["cluster"], r["at"]] = r["value"]
    return got[:, 0], got[:, 1:-1], got[:, -1].tolist()


def first_centroids(points: DataFrame, many: int, width: int = WIDTH) -> np.ndarray:
    """The ``many`` vectors with the smallest SHA-256 of ``1:<id>``; equal hashes by the vector, null ids last."""
    name = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")).cast("binary"), 256)
    rows = points.orderBy(name.asc_nulls_last(), "v").limit(many).select("v").toArrow().combine_chunks()
    return integers(rows["v"].combine_chunks(), width) if rows.num_rows else np.zeros((0, width), np.int64)


def fit(points: DataFrame, cut: DataFrame, many: int, rounds: int, width: int = WIDTH) -> np.ndarray:
    """Centroids after ``rounds`` turns; each becomes the floor of the mean of its vectors, one without vectors stays."""
    centroids = first_centroids(points, many, width)
    for _ in range(rounds if len(centroids) else 0):
        n, total, _ = sums(cut, centroids)
        centroids = np.where(n[:, None] > 0, total // np.maximum(n, 1)[:, None], centroids)
    return centroids


def cluster(df: DataFrame, stage: Stage, id_col: str = "vec_id", vector: str = "embedding", many: int = 16, rounds: int = 3, width: int = WIDTH) -> DataFrame:
    """One row per usable vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid_sha256.

    Vectors are ordered along a Hilbert curve over their main axes and stored in blocks with a min/max box, count
    and sums. In every round the box leaves a few candidates per block; a block with one candidate gives its stored
    sums, the others are compared exactly with their candidates, as a matrix product. The driver holds the
    centroids (``many`` rows).

    Vectors of another length, null ones and those with a null, NaN or infinite component have no row; components
    beyond LIMIT / SCALE count as that. Repeated rows and ids count each; null ids are clustered but start no
    centroid before others; of equally near centroids the smaller number is taken. With fewer vectors than
    ``many`` there are as many centroids as vectors, and no rows give no rows. Other columns are ignored. An inertia of
    2**63 and more fails the job.
    """
    points = usable(df, id_col, vector, width)
    cut = blocks(points, stage, width)
    centroids = fit(points, cut, many, rounds, width)
    n, total, squares = sums(cut, centroids) if len(centroids) else ([], [], [])
    inertia = [s - 2 * sum(a * b for a, b in zip(c, t)) + int(k) * sum(a * a for a in c) for k, t, s, c in zip(n, np.asarray(total).tolist(), squares, centroids.tolist())]
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def label(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            found, far = [], []
            for _, own, x in assign(batch, centroids):
                own = np.full(len(x), own) if isinstance(own, int) else own
                apart = x.astype(np.int64) - centroids[own]
                found.append(own), far.append((apart * apart).sum(1))
            own = np.concatenate(found)
            yield pa.RecordBatch.from_arrays(
                [batch.column(3).flatten(), pa.array(own.astype(np.int32)), pa.array(np.concatenate(far)), pa.array(np.array(inertia, np.int64)[own]),
                 pa.array(np.full(len(own), sum(inertia), np.int64)), pa.array(np.array(names, object)[own], pa.string())],
                names=[id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    kind = points.schema["id"].dataType.simpleString()
    return cut.select("lo", "hi", "n", "ids", "vectors").mapInArrow(label, f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
