"""Exact linking inside buckets without forming all pairs of a bucket."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photospark.llm.components import components
from photospark.llm.stage import Stage

CENTRES, FIRST = 512, 4
#: A bucket whose rows agree in pairs at more than MANY a row is handed on whole; PROBE of its pairs tell so beforehand if it has more, and BLOCK are compared at once.
MANY, PROBE, BLOCK = 6, 1 << 14, 1 << 19
#: Keys are cut to 64 - CUT bits; a task sorts RUN of them at a time, and about PART meet in one group.
CUT, RUN, PART = 24, 1 << 21, 1 << 20


def packed(x: np.ndarray) -> bytes:
    """Unsigned words as planes of bytes, without the high ones that are all zero."""
    used = (int(x.max()).bit_length() + 7) // 8
    return bytes([used]) + x.view(np.uint8).reshape(-1, 8)[:, :used].T.tobytes()


def unpacked(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :data[0]] = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], n).T
    return out.view(np.uint64).reshape(-1)


def tight(x: np.ndarray, raw: int) -> bytes:
    """``packed`` with the planes above the lowest ``raw`` deflated, as they hold few different bytes."""
    data = packed(x)
    at = 1 + min(raw, data[0]) * len(x)
    return data[:at] + zlib.compress(data[at:], 1)


def loose(data: bytes, n: int, raw: int) -> np.ndarray:
    at = 1 + min(raw, data[0]) * n
    return unpacked(data[:at] + zlib.decompress(data[at:]), n)


def gather(nodes: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]], many: int) -> DataFrame:
    """(key, node, a, z): the nodes of every bucket with at least two, and the least and the largest of them.

    ``keys_of`` gives (rows, keys) arrays of a batch, ``many`` is about the number of all keys. A bucket of three or more has a row per
    node; one of two is a row with a null key, the larger as ``node`` and the smaller as ``a`` and ``z``. Keys travel once, sorted
    and packed by ranges of the key; buckets are cut out of a range by the task that has it.
    """
    ranges = max(4, (many // PART).bit_length())
    parts = 1 << ranges

    def deal(batches):
        nodes, at, keys, size = [], [], [], 0

        def flush():
            names = np.concatenate(nodes)
            both = np.sort((np.concatenate(keys) >> np.uint64(CUT) << np.uint64(CUT)) | np.concatenate(at).astype(np.uint64))
            ends = np.append(np.searchsorted(both, np.arange(parts, dtype=np.uint64) << np.uint64(64 - ranges)), len(both))
            rows = []
            for part in np.flatnonzero(np.diff(ends)).tolist():
                own = both[ends[part]:ends[part + 1]]
                key, name = own >> np.uint64(CUT), names[(own & np.uint64((1 << CUT) - 1)).astype(np.int64)]
                least = int(name.min())
                rows.append((part, len(own), least, packed(np.diff(key, prepend=np.uint64(0))), packed((name - least).view(np.uint64))))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))], names=["part", "n", "least", "keys", "names"])

        for batch in batches:
            names, base = batch.column(0).to_numpy(), sum(map(len, nodes))
            nodes.append(names)
            for row, key in keys_of(batch):
                at.append(row + base)
                keys.append(key)
                size += len(key)
            if size >= RUN or base + len(names) > RUN:
                if size:
                    yield from flush()
                nodes, at, keys, size = [], [], [], 0
        if size:
            yield from flush()

    def cut(table: pa.Table) -> pa.Table:
        key, name = [], []
        for n, least, k, v in zip(*[table.column(c).to_pylist() for c in ("n", "least", "keys", "names")]):
            key.append(np.cumsum(unpacked(k, n), dtype=np.uint64).view(np.int64))
            name.append(unpacked(v, n).view(np.int64) + least)
        key, name = np.concatenate(key), np.concatenate(name)
        order = np.lexsort((name, key))
        key, name = key[order], name[order]
        new = np.append(True, (key[1:] != key[:-1]) | (name[1:] != name[:-1]))
        key, name = key[new], name[new]
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(head, len(key)))
        two, more = head[size == 2], size > 2
        inside = np.repeat(more, size)
        a, z = (np.repeat(name[x][more], size[more]) for x in (head, head + size - 1))
        keys = pa.array(np.concatenate([key[inside], np.zeros(len(two), np.int64)]), mask=np.append(np.zeros(int(inside.sum()), bool), np.ones(len(two), bool)))
        rows = [np.concatenate(x) for x in ((name[inside], name[two + 1]), (a, name[two]), (z, name[two]))]
        return pa.Table.from_arrays([keys, *map(pa.array, rows)], names=["key", "node", "a", "z"])

    dealt = nodes.mapInArrow(deal, "part int, n int, least long, keys binary, names binary")
    return dealt.groupBy("part").applyInArrow(cut, "key long, node long, a long, z long")


def meet(nodes: DataFrame, keys_of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, int, np.ndarray]]], many: int, marks: int, reach: Callable[[np.ndarray], np.ndarray],
         agree: Callable[..., np.ndarray]) -> DataFrame:
    """Buckets as ``gather`` gives them, of nodes that ``agree``: what the marks of two nodes in a bucket rule out is no pair.

    ``keys_of`` gives (rows, keys, kind, marks) of a batch: a kind from 0 to 3 for all keys and for each a size (uint16) and ``marks`` bytes, that travel with
    the key. Nodes of a bucket can agree only if the larger size is at most ``reach`` of the smaller; ``agree(kind, size, mark, size, mark)`` judges
    pairs, the smaller size first. A bucket with few pairs that agree is given as buckets of two, others are given whole. Keys are cut to the bits that tell ``many`` of them apart.
    """
    ranges, bits = max(4, (many // PART).bit_length()), min(62 - CUT, many.bit_length() + 8)
    parts = 1 << ranges

    def deal(batches):
        nodes, at, keys, sizes, signs, size = [], [], [], [], [], 0

        def flush():
            names = np.concatenate(nodes)
            both = (np.concatenate(keys) << np.uint64(CUT)) | np.concatenate(at).astype(np.uint64)
            order = np.argsort(both)
            both, lot, sign = both[order], np.concatenate(sizes)[order], np.concatenate(signs)[order]
            ends = np.append(np.searchsorted(both, np.arange(parts, dtype=np.uint64) << np.uint64(CUT + 2 + bits - ranges)), len(both))
            rows = []
            for part in np.flatnonzero(np.diff(ends)).tolist():
                a, z = ends[part], ends[part + 1]
                key, name = both[a:z] >> np.uint64(CUT), names[(both[a:z] & np.uint64((1 << CUT) - 1)).astype(np.int64)]
                least = int(name.min())
                rows.append((part, z - a, least, tight(np.diff(key, prepend=np.uint64(0)), 2), tight((name - least).view(np.uint64), 2), tight(lot[a:z].astype(np.uint64), 1), sign[a:z].T.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4))], names=["part", "n", "least", "keys", "names", "sizes", "marks"])

        for batch in batches:
            names, base = batch.column(0).to_numpy(), sum(map(len, nodes))
            nodes.append(names)
            for row, key, kind, lot, sign in keys_of(batch):
                at.append(row + base)
                keys.append(key >> np.uint64(64 - bits) << np.uint64(2) | np.uint64(kind))
                sizes.append(lot)
                signs.append(sign)
                size += len(key)
                if size >= RUN:  # the nodes stay for the rest of the batch
                    yield from flush()
                    at, keys, sizes, signs, size = [], [], [], [], 0
            if base + len(names) > RUN:
                if size:
                    yield from flush()
                nodes, at, keys, sizes, signs, size = [], [], [], [], [], 0
        if size:
            yield from flush()

    def cut(table: pa.Table) -> pa.Table:
        key, name, lot, sign = [], [], [], []
        for n, least, k, v, s, m in zip(*[table.column(c).to_pylist() for c in ("n", "least", "keys", "names", "sizes", "marks")]):
            key.append(np.cumsum(loose(k, n, 2), dtype=np.uint64))
            name.append(loose(v, n, 2).view(np.int64) + least)
            lot.append(loose(s, n, 1))
            sign.append(np.frombuffer(m, np.uint8).reshape(marks, n).T)
        key, name, lot, sign = map(np.concatenate, (key, name, lot, sign))
        sized = key << np.uint64(16) | lot
        order = np.argsort(sized)
        key, name, lot, sign, sized = key[order], name[order], lot[order], sign[order], sized[order]
        far = np.searchsorted(sized, key << np.uint64(16) | np.minimum(reach(lot), 65535).astype(np.uint64), "right") - np.arange(len(key)) - 1
        head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        count, work, kind = np.diff(np.append(head, len(key))), np.add.reduceat(far, head), (key & np.uint64(3)).astype(np.uint8)

        def passed(u: np.ndarray, v: np.ndarray) -> np.ndarray:
            return agree(kind[u], lot[u], sign[u], lot[v], sign[v]) & (name[u] != name[v])

        def formed(rows: np.ndarray):
            """The pairs that agree of some rows with all behind them."""
            us, vs, done = [], [], np.cumsum(far[rows])
            while len(rows):
                take = max(1, int(np.searchsorted(done, BLOCK, "right")))
                own, n = rows[:take], far[rows[:take]]
                u = np.repeat(own, n)
                v = u + 1 + np.arange(len(u)) - np.repeat(np.cumsum(n) - n, n)
                ok = passed(u, v)
                us.append(u[ok])
                vs.append(v[ok])
                rows, done = rows[take:], done[take:] - (done[take - 1] if take else 0)
            return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, np.int64),) * 2

        whole = np.zeros(len(head), bool)
        draw = np.random.default_rng(len(key))
        for b in np.flatnonzero(work > PROBE).tolist():
            u = head[b] + draw.integers(0, count[b], PROBE)
            u = u[far[u] > 0]
            v = u + 1 + draw.integers(0, far[u]) if len(u) else u
            # each row is drawn alike, so what agrees is weighed by what stands behind it
            whole[b] = len(u) and float(far[u][passed(u, v)].sum()) / PROBE > MANY
        bucket = np.repeat(np.arange(len(head)), count)
        u, v = formed(np.flatnonzero((far > 0) & ~whole[bucket]))
        whole |= np.bincount(bucket[u], minlength=len(head)) > MANY * count
        few = ~whole[bucket[u]]
        pair = np.unique(np.stack([np.minimum(name[u[few]], name[v[few]]), np.maximum(name[u[few]], name[v[few]])], 1), axis=0)
        inside = whole[bucket]
        ends = [np.repeat(f.reduceat(name, head)[whole], count[whole]) for f in (np.minimum, np.maximum)]
        keys = pa.array(np.concatenate([key[inside].view(np.int64), np.zeros(len(pair), np.int64)]), mask=np.append(np.zeros(int(inside.sum()), bool), np.ones(len(pair), bool)))
        rows = [np.concatenate(x) for x in ((name[inside], pair[:, 1]), (ends[0], pair[:, 0]), (ends[1], pair[:, 0]))]
        return pa.Table.from_arrays([keys, *map(pa.array, rows)], names=["key", "node", "a", "z"])

    dealt = nodes.mapInArrow(deal, "part int, n int, least long, keys binary, names binary, sizes binary, marks binary")
    return dealt.groupBy("part").applyInArrow(cut, "key long, node long, a long, z long")


def link(buckets: DataFrame, points: DataFrame, near: Callable[[str, str], Column], apart: Callable[[str, str], Column], verify: Callable[[DataFrame, str], DataFrame], stage: Stage,
         detail: DataFrame | None = None, alike: Callable[[str, str], Column] = lambda a, b: F.lit(True)) -> DataFrame:
    """(node, root) of all nodes with a link; a link is a pair in one bucket that passes ``near`` and ``verify``.

    ``buckets`` are as ``gather`` gives them, ``points`` has (node, p), p being what ``near`` compares. ``near(a, b)`` is a cheap condition on two such
    columns, ``apart(a, b)`` their distance, ``verify(pairs, name)`` turns pairs (u, v) into the confirmed ones.
    ``detail`` (node, bands, q) has all keys of a node and what ``alike(a, b)``, a finer condition, compares; with it a
    pair is formed only in the first bucket that its nodes share.

    First every node is held against the FIRST closest (by ``apart``) among the least and the largest node of its
    buckets, which joins groups of copies, also chains of them, by a few links per node. Pairs of buckets of two that
    are still apart come next. Then, of each larger bucket that
    still spans several components, the members outside its largest component (any pair across components has one)
    are centres, held against all members of other components. A bucket with more than CENTRES of them takes as many
    by hash, these leave it, and it comes again with ever more. So every pair of a bucket is held against each other
    or lies in one component: no link is lost, and a group of n copies costs about n pairs, not n * n.
    """
    held = stage.write(buckets, "held")
    ends = held.select("node", F.explode(F.array("a", "z")).alias("c"), F.col("key").isNull().alias("two")).where("node <> c").groupBy("node", "c").agg(F.max("two").alias("two"))
    beside = ends.join(points, "node").join(points.select(F.col("node").alias("c"), F.struct("p").alias("o")), "c").where(near("o.p", "p"))
    beside = stage.write(beside.select("node", "c", apart("o.p", "p").alias("d"), "two"), "beside")
    closest = beside.groupBy("node").agg(F.slice(F.array_sort(F.collect_set(F.struct("d", F.col("c").alias("u")))), 1, FIRST).alias("us"))
    first = closest.select("node", F.explode("us.u").alias("u")).select(F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct()
    first = stage.write(first, "first")
    edges = verify(first, "v0")
    groups = components(edges, stage, "groups0-")

    def rooted(rows: DataFrame, node: str, root: str) -> DataFrame:
        return rows.join(groups.select(F.col("node").alias(node), F.col("root").alias("_root")), node, "left").withColumn(root, F.coalesce("_root", node)).drop("_root")

    waiting, turn = held.where("key IS NOT NULL").select("key", "node"), 0
    twos = rooted(rooted(beside.where("two").select(F.least("node", "c").alias("u"), F.greatest("node", "c").alias("v")).join(first, ["u", "v"], "left_anti"), "u", "ur"), "v", "vr")
    found = verify(stage.write(twos.where("ur <> vr").select("u", "v").distinct(), "twos"), "v-twos")
    stage.drop("first", "beside", "twos")
    edges = stage.write(edges.unionByName(found), "edges0")
    stage.drop("v0", "v-twos")
    groups = components(edges, stage, "groups-twos-")
    while True:
        turn += 1
        now = rooted(waiting, "node", "root")
        sizes = now.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("key").agg(F.sum("n").alias("n"), F.max(F.struct("n", "root")).alias("top"))
        mixed = stage.write(sizes.where("n > top.n").select("key", F.col("top.root").alias("major"), (F.col("n") - F.col("top.n")).alias("minor")), f"mixed{turn}")
        left = mixed.agg(F.count(F.lit(1)).alias("n"), F.max("minor").alias("most")).first()
        if not left["n"]:
            return groups
        live = now.join(mixed, "key").join(points, "node")
        live = stage.write(live.join(detail, "node") if detail is not None else live.withColumns({"bands": F.array("key"), "q": F.lit(0)}), f"live{turn}")
        slot = F.when(F.col("minor") <= CENTRES, F.col("node")).otherwise(F.pmod(F.xxhash64("node", "key", F.lit(turn)), F.lit(CENTRES * 64 ** (turn - 1))))
        centres = stage.write(live.where("root <> major").groupBy("key", slot.alias("slot")).agg(F.min_by(F.struct("node", "p", "root", "bands", "q"), "node").alias("c")).select(
            "key", F.col("c.node").alias("u"), F.col("c.p").alias("cp"), F.col("c.root").alias("cr"), F.col("c.bands").alias("cb"), F.col("c.q").alias("cq")), f"centres{turn}")
        shared = F.get("bands", F.array_position(F.zip_with("bands", "cb", lambda a, b: a == b), True).cast("int") - 1)
        here = shared == F.col("key") if detail is None else F.shiftrightunsigned(shared, CUT) == F.col("key")
        pairs = live.join(centres, "key").where((F.col("root") != F.col("cr")) & near("cp", "p") & alike("cq", "q") & here).select(
            F.least("u", "node").alias("u"), F.greatest("u", "node").alias("v")).distinct()
        found = verify(stage.write(pairs, f"pairs{turn}"), f"v{turn}")
        edges = stage.write(edges.unionByName(found), f"edges{turn}")
        stage.drop(f"v{turn}", f"edges{turn - 1}", f"pairs{turn}")
        groups = components(edges, stage, f"groups{turn}-")
        if left["most"] <= CENTRES:
            return groups
        over = live.where(F.col("minor") > CENTRES).select("key", "node")
        waiting = stage.write(over.join(centres.select("key", F.col("u").alias("node")), ["key", "node"], "left_anti"), f"waiting{turn}")
        stage.drop(f"mixed{turn}", f"live{turn}", f"centres{turn}", f"waiting{turn - 1}")
