"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photospark.llm import kernels as K
from photospark.llm.buckets import gather, link
from photospark.llm.stage import Stage, maybe_in

BITS, BANDS, ROWS = 20, 60, 5
SKETCH, AGREED, COARSE, SIMILAR = 1024, 852, 256, 200
_permutations: list[np.ndarray] = []


def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The two permutations of the 2**BITS hash buckets; the second is continued in a circle by the length of a signature."""
    if not _permutations:
        rng = np.random.Generator(np.random.PCG64(20240603))
        first, second = (rng.permutation(1 << BITS).astype(np.uint32) for _ in range(2))
        _permutations.extend([first, np.concatenate([second, second[:SKETCH]])])
    return _permutations[0], _permutations[1]


def signature(shingles: np.ndarray) -> np.ndarray:
    """Coordinate k is the least value that the second permutation, shifted by k in a circle, gives the set permuted by the first."""
    first, second = permutations()
    spots = first[(shingles >> np.uint64(64 - BITS)).astype(np.int64)]
    shifted = sliding_window_view(second, SKETCH)
    out = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    for lo in range(0, len(spots), 1024):
        np.minimum(out, shifted[spots[lo:lo + 1024]].min(0), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of a signature (rows), from its first BANDS * ROWS coordinates."""
    parts = signatures[:, :BANDS * ROWS].reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), parts.shape[:2]) + np.uint64(1)
    for r in range(ROWS):
        key = K.mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, r])
    return K.signed(np.ascontiguousarray(key))


def sketch_of(signatures: np.ndarray) -> np.ndarray:
    """The lowest bits of the coordinates as 64-bit words (rows)."""
    return np.packbits((signatures & 1).astype(bool), axis=1).view(np.int64)


def set_name(shingles: np.ndarray) -> int:
    """64 bits that name a set: a mixed sum of its mixed hashes and its size."""
    return int(K.mix(K.mix(shingles ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64, keepdims=True) + np.array([len(shingles)], np.uint64)).view(np.int64)[0])


def lowered(data: np.ndarray) -> np.ndarray:
    return K.LOWER[data]


def sets_of(column: pa.Array):
    """Shingle sets (sorted hashes, A-Z lower-cased) of whole texts, in order."""
    for _, _, data, offsets in K.chunks(column):
        yield from K.shingles(K.Words(lowered(data), offsets))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n, node, bands, sketch): set size, name of the set, its band keys and sketch (null for an empty set)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def mark(batches):
        for batch in batches:
            sizes, names, marks = [], [], []
            for s in sets_of(batch.column(1)):
                sizes.append(len(s))
                names.append(set_name(s) if len(s) else None)
                if len(s):
                    marks.append(signature(s))
            some = np.array(sizes, np.int64) > 0
            full = np.stack(marks) if marks else np.zeros((0, SKETCH), np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.int64()), _lists(band_keys(full), some), _lists(sketch_of(full), some)],
                names=["doc_id", "n", "node", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(mark, f"doc_id {kind}, n long, node long, bands array<long>, sketch array<long>")


def _lists(rows: np.ndarray, some: np.ndarray) -> pa.Array:
    """A list per flag, the next row of ``rows`` where it is set and an empty one elsewhere."""
    ends = np.concatenate([[0], np.cumsum(some * rows.shape[1])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(rows).reshape(-1)))


def banded(batch: pa.RecordBatch):
    """(rows, keys) of a batch (node, bands)."""
    lists = batch.column(1)
    yield np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy().view(np.uint64)


def confirm(pairs: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) whose whole texts (ut, vt) have the named sets and a Jaccard of ``percent`` or more."""
    def hold(batches):
        for batch in batches:
            us, vs, keep = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for u, v, a, b in zip(us, vs, sets_of(batch.column(2)), sets_of(batch.column(3))):
                both = len(a) + len(b) - len(np.union1d(a, b)) if len(a) and len(b) else 0
                keep.append(both > 0 and 100 * both >= percent * (len(a) + len(b) - both) and set_name(a) == u and set_name(b) == v)
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    return pairs.select("u", "v", "ut", "vt").mapInArrow(hold, "u long, v long").distinct()


def near_duplicates(docs: DataFrame, stage: Stage, percent: int = 75) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Sets are the distinct five-word shingles of whole texts, A-Z lower-cased; a shorter text is one shingle. Equal
    sets are one node, so copies cost nothing later. Nodes that share a band are candidates, confirmed on the full
    sets; candidates whose sizes differ too much, or whose sketches (one bit per coordinate) agree in fewer than 852
    of 1024 bits, are not: at the threshold 896 are expected with a deviation of 10.6, so one in 60,000 such pairs is
    missed unless other links join them, and of pairs at 0.77 one in millions. A pair at the threshold shares
    none of the 60 bands of 5 rows with a chance of 9e-8.

    A null or empty text or one without words has no shingles, is linked with nothing and kept. Rows with a null
    id are linked with nothing (component_id null, kept). Rows that repeat an
    id with another text are nodes of their own under that id; rows repeated as a whole all stay or all go. Other columns are ignored; no rows give no rows.
    """
    outer, stage = stage, stage.inner("links")
    prints = stage.write(fingerprints(docs), "prints")
    own = outer.write(prints.select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("node")).alias("node")), "own")
    named = prints.where("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes, seen = stage.write_measured(named.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.min_by(F.struct("bands", "sketch"), "doc_id").alias("s")).select("node", "doc_id", "n", "s.*"), "nodes", n=F.count(F.lit(1)))
    buckets = gather(nodes.select("node", "bands"), banded, BANDS * (seen["n"] or 0))
    points = nodes.select("node", F.struct("n", F.slice("sketch", 1, COARSE // 64).alias("sketch")).alias("p"))

    def differ(a: str, b: str, bits: int):
        return sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))) for k in range(bits // 64)), F.lit(0))

    def apart(a: str, b: str):
        return differ(f"{a}.sketch", f"{b}.sketch", COARSE)

    def near(a: str, b: str):
        sizes = 100 * F.least(f"{a}.n", f"{b}.n") >= percent * F.greatest(f"{a}.n", f"{b}.n")
        return sizes & (apart(a, b) <= COARSE - SIMILAR)

    def alike(a: str, b: str):
        return differ(a, b, SKETCH) <= SKETCH - AGREED

    def verify(pairs: DataFrame, name: str) -> DataFrame:
        wanted = pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct()
        ids = stage.write(nodes.select("node", "doc_id").join(wanted, "node"), f"{name}-ids")
        texts = docs.select("doc_id", "text").where(maybe_in(ids, "doc_id", F.col("doc_id"))).join(ids, "doc_id").select("node", "text")
        texts = stage.write(texts, f"{name}-texts")
        both = pairs.join(texts.select(F.col("node").alias("u"), F.col("text").alias("ut")), "u").join(texts.select(F.col("node").alias("v"), F.col("text").alias("vt")), "v")
        out = stage.write(confirm(both, percent), name)
        stage.drop(f"{name}-texts")
        return out

    groups = link(buckets, points, near, apart, verify, stage, nodes.select("node", "bands", F.col("sketch").alias("q")), alike)
    least = nodes.join(groups, "node").groupBy("root").agg(F.min("doc_id").alias("least"))
    linked = nodes.join(groups, "node").join(least, "root").select("node", "least")
    classes = outer.write(nodes.select("node", "doc_id").join(linked, "node", "left").select("node", F.coalesce("least", "doc_id").alias("component_id")), "classes")
    stage.clear()
    return own.join(classes, "node", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
