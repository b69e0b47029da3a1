"""Benchmark decontamination by greedy string tiling over shared-token seeds."""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photospark.llm import kernels as K

TOKEN = re.compile(r"[^\W_]+")
SEED, COVERED, BLOCK = 5, 0.6, 5_000


def tokens(text: str | None) -> list[str]:
    """Runs of letters and digits, lower-cased, so punctuation and case don't hide a passage."""
    return TOKEN.findall((text or "").lower())


def tile(doc: list[int], item: list[int], shortest: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy string tiling: tiles (place in the document, place in the item, length) of unmarked tokens, longest first.

    Running Karp-Rabin: for a search length, unmarked windows of the item are hashed and looked up from the
    document's unmarked windows; equal windows are grown as far as both sides are equal and unmarked. A match far
    longer than the search length restarts the scan with that length; else all matches of the round are marked,
    longest first, and the length is lowered down to ``shortest``. Ties go to the first place in the document, then
    in the item.
    """
    taken_d, taken_i = [False] * len(doc), [False] * len(item)
    tiles: list[tuple[int, int, int]] = []
    length = max(shortest, min(20, len(item)))
    while True:
        found, longest = _matches(doc, item, taken_d, taken_i, length)
        if longest > 2 * length:
            length = longest
            continue
        for size, d, i in sorted(found, key=lambda m: (-m[0], m[1], m[2])):
            if not any(taken_d[d:d + size]) and not any(taken_i[i:i + size]):
                taken_d[d:d + size] = taken_i[i:i + size] = [True] * size
                tiles.append((d, i, size))
        if length > 2 * shortest:
            length //= 2
        elif length > shortest:
            length = shortest
        elif not _matches(doc, item, taken_d, taken_i, length)[0]:
            return tiles


def _matches(doc: list[int], item: list[int], taken_d: list[bool], taken_i: list[bool], length: int) -> tuple[list[tuple[int, int, int]], int]:
    table = defaultdict(list)
    for i, key in _rolling(item, taken_i, length):
        table[key].append(i)
    found, longest = [], 0
    ahead: dict[int, int] = {}
    for d, key in _rolling(doc, taken_d, length):
        for i in table.get(key, ()):
            if d < ahead.get(i - d, -1) or doc[d:d + length] != item[i:i + length]:
                continue
            size = length
            while d + size < len(doc) and i + size < len(item) and doc[d + size] == item[i + size] and not taken_d[d + size] and not taken_i[i + size]:
                size += 1
            ahead[i - d] = d + size
            found.append((size, d, i))
            longest = max(longest, size)
    return found, longest


def _rolling(xs: list[int], taken: list[bool], length: int):
    """(place, rolling hash) of the windows without a marked token."""
    base, mod = 1_000_003, (1 << 61) - 1
    top, value, run = pow(base, length - 1, mod), 0, 0
    for at, x in enumerate(xs):
        if taken[at]:
            value = run = 0
            continue
        if run == length:
            value = (value - xs[at - length] * top) % mod
        else:
            run += 1
        value = (value * base + x) % mod
        if run == length:
            yield at - length + 1, value


class Seeds:
    """Shared-token seeds of a block of test items: hashed windows of SEED tokens and the items that hold them.

    Items with fewer tokens than a seed are one seed of all their tokens.
    """

    def __init__(self, items: list[tuple[int, str]], seed: int = SEED):
        self.ids, self.words = [k for k, _ in items], [tokens(t) for _, t in items]
        by: dict[int, set] = defaultdict(set)
        for k, words in enumerate(self.words):
            if words:
                size = min(seed, len(words))
                h = word_hashes(words)
                for key in window_hashes(h, size).tolist():
                    by[key].add(k)
        self.by, self.sizes = dict(by), sorted({min(seed, len(w)) for w in self.words if w})
        self.bits = np.zeros(1 << 22, bool)
        self.bits[(np.array(list(by), np.uint64) >> np.uint64(42)).astype(np.int64)] = True

    def shared(self, words: list[str]) -> dict[int, list[int]]:
        """Items that share a seed with the document, with the document's places of the seeds."""
        found: dict[int, list[int]] = defaultdict(list)
        if not words:
            return found
        h = word_hashes(words)
        for size in self.sizes:
            keys = window_hashes(h, size)
            places = np.flatnonzero(self.bits[(keys >> np.uint64(42)).astype(np.int64)])
            for at, key in zip(places.tolist(), keys[places].tolist()):
                for item in self.by.get(key, ()):
                    found[item].append(at)
        return found


def word_hashes(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    return K.Words(np.frombuffer(data, np.uint8), np.array([0, len(data)])).hash


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    n = max(0, len(h) - size + 1)
    out = np.zeros(n, np.uint64)
    for j in range(size):
        out += h[j:j + n] * K._PLACE[j]
    return K.mix(out + np.uint64(size))


def cover(words: list[str], item: list[str], places: list[int], seed: int = SEED) -> tuple[float, list[tuple[int, int, int]]]:
    """(share of the item's tokens under tiles, tiles). Only tokens under a shared seed can be in a tile, so only they are tiled."""
    names: dict[str, int] = {}
    size = min(seed, len(item))
    other = [names.setdefault(w, len(names) + 1) for w in item]
    own, origin, end = [], [], -1
    for at in sorted(set(places)):
        if at > end:
            own.append(-1 - len(own))
            origin.append(-1)
        for k in range(max(at, end), at + size):
            own.append(names.get(words[k], 0))
            origin.append(k)
        end = max(end, at + size)
    tiles = [(origin[d], i, n) for d, i, n in tile(own, other, size)]
    return sum(t[2] for t in tiles) / len(item), tiles


TILES = "array<struct<item_id:bigint,coverage:double,tiles:array<struct<doc_at:int,item_at:int,length:int>>>>"
_TILE = pa.struct([("doc_at", pa.int32()), ("item_at", pa.int32()), ("length", pa.int32())])
_TILES = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(_TILE))]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, covered: float = COVERED, block: int = BLOCK) -> DataFrame:
    """Adds ``leaks`` (TILES) to the documents: the test items that a document covers with their tiles; empty without one.

    The test set is the stated query side. It goes to the tasks in blocks of about ``block`` items, cut by hash of the
    id, and each block is held against all documents; no document leaves its task, so hot passages and sources
    need no care. Only documents with a shared seed of SEED tokens are tiled, and only against the items they share
    one with.

    Texts are compared as lower-cased letter and digit runs. A null or empty document covers nothing; a test item
    without tokens is covered by nothing; an item shorter than a seed has to occur as a whole; test items without
    id are left out, equal ones are reported by each id, and of one id with several texts each text counts; repeated
    documents are judged each; other columns stay, but for one named ``leaks``; no rows give no rows.
    """
    docs = docs.drop("leaks")
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    parts = -(-items.count() // block)
    out = docs.withColumn("leaks", F.array().cast(TILES))
    for k in range(parts):
        rows = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k).collect()
        out = _hold(out, [(r["item_id"], r["text"]) for r in rows], covered)
    return out


def _hold(docs: DataFrame, items: list[tuple[int, str]], covered: float) -> DataFrame:
    names = docs.columns
    text, leaks = names.index("text"), names.index("leaks")

    def search(batches):
        seeds = Seeds(items)
        for batch in batches:
            out = []
            for t, old in zip(batch.column(text).to_pylist(), batch.column(leaks).to_pylist()):
                words, hits = tokens(t), list(old)
                for at, places in sorted(seeds.shared(words).items()):
                    share, tiles = cover(words, seeds.words[at], places)
                    if share >= covered:
                        hits.append({"item_id": seeds.ids[at], "coverage": round(share, 6), "tiles": [{"doc_at": d, "item_at": i, "length": n} for d, i, n in sorted(tiles)]})
                out.append(sorted(hits, key=lambda h: (h["item_id"], -h["coverage"])))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names)) if i != leaks], pa.array(out, _TILES)], names=[*[n for n in names if n != "leaks"], "leaks"])

    order = docs.select(*[n for n in names if n != "leaks"], "leaks")
    text, leaks, names = order.columns.index("text"), len(names) - 1, order.columns
    return order.mapInArrow(search, order.schema)


def judge(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, kept, item_ids, coverage): a document that covers a test item isn't kept."""
    found = find_leaks(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id", (F.size("leaks") == 0).alias("kept"), F.array_distinct(F.col("leaks.item_id")).alias("item_ids"),
        F.coalesce(F.array_max("leaks.coverage"), F.lit(0.0)).alias("coverage"), F.aggregate("leaks", F.lit(0), lambda a, x: a + F.size(x["tiles"])).alias("n_tiles"))
