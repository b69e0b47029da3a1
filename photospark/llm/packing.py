"""Vector best-fit packing of tokenized documents into sequences."""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photospark.llm.stage import Stage

END, SIZE = 2, 1024
#: A run this long goes to the slower library, whose merging doesn't depend on the length of a run.
LONG_RUN = 20_000
_RUN = re.compile(r"\S{%d}|\s{%d}" % (LONG_RUN, LONG_RUN))


class Encoder:
    """Token ids of whole texts as little-endian 32-bit words.

    ``tokenizer`` is (tokenizers file, the same vocabulary as ranks, pattern of its words). The ranks give the same
    ids at a third of the time; texts with a special token's string or a very long run use the tokenizers file itself.
    """

    def __init__(self, tokenizer: tuple[str, str, str]):
        import tiktoken

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, ranks, pattern = tokenizer
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast, self.slow = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}), None
        self.special = tuple(x["content"] for x in json.loads(Path(self.path).read_text())["added_tokens"])

    def encode(self, text: str | None) -> bytes:
        """Ids of a text (null: none), without special tokens added."""
        text = text or ""
        if any(s in text for s in self.special) or len(text) >= LONG_RUN and _RUN.search(text):
            if self.slow is None:
                from tokenizers import Tokenizer

                self.slow = Tokenizer.from_file(self.path)
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: tuple[str, str, str], size: int = SIZE) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): ids of a text plus END, cut into ``size``; the first piece takes the rest."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                index, piece, start, length, crc = [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    ids = encoder.encode(text) + END.to_bytes(4, "little")
                    n = len(ids) // 4
                    at, k = 0, 0
                    step = n % size or size
                    while at < n:
                        index.append(row), piece.append(k), start.append(at), length.append(step), crc.append(zlib.crc32(ids[4 * at:4 * (at + step)]))
                        at, k, step = at + step, k + 1, size
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(index, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit(counts: dict[int, int], size: int = SIZE, documents: int = SIZE, cost: int = SIZE * SIZE, rule: str = "norm", weights=(1.0, 0.1, 0.2)) -> list[tuple[int, int, int, int, int, int]]:
    """Vector best-fit decreasing over a histogram of lengths.

    A piece of length n needs (n tokens, 1 document, n * n attention cost). Bins of equal filling are one class with a
    number, so the work follows the number of lengths, not of pieces. For each length, longest first, the class
    that can take it under every capacity is chosen: by the least weighted norm of what would remain ("norm"), or by
    the largest weighted dot-product of need and remainder ("dot"); without one, bins are opened. Needs and
    remainders are shares of the capacities; ties go to the older class.

    Gives runs (length, first rank, end rank, copies, first sequence, offset): of the pieces of a length, those with
    these ranks lie in the sequences from ``first sequence`` on, ``copies`` in each, from ``offset``.
    """
    caps, w = np.array([size, documents, cost], float), np.array(weights)
    left: list[list[int]] = []
    number: list[int] = []
    filled: list[list[tuple[int, int]]] = []
    room = np.zeros((64, 3))

    def add(rest, many: int, items: list[tuple[int, int]]) -> None:
        nonlocal room
        if len(number) == len(room):
            room = np.concatenate([room, np.zeros_like(room)])
        room[len(number)] = rest
        left.append(list(rest)), number.append(many), filled.append(items)

    for length in sorted(counts, reverse=True):
        need, todo = np.array([length, 1, length * length], float), counts[length]
        if (need > caps).any():
            raise ValueError(f"a piece of {length} tokens is beyond a capacity")
        while todo:
            open_ = room[:len(number)]
            fits = np.flatnonzero((open_ >= need).all(1) & (np.array(number, bool) if number else np.zeros(0, bool)))
            if len(fits):
                after = (open_[fits] - need) / caps
                best = after * after @ w if rule == "norm" else -((open_[fits] / caps) * (need / caps)) @ w
                at = int(fits[int(np.argmin(best))])
                rest, bins, items = room[at].copy(), number[at], filled[at]
            else:
                at, rest, bins, items = -1, caps.copy(), todo, []
            copies = int(min((rest // need).min(), todo)) if rule == "norm" or at < 0 else 1
            used = min(bins, todo // copies)
            if at >= 0:
                number[at] -= used
            add(rest - copies * need, used, [*items, (length, copies)])
            todo -= used * copies
    runs, rank, first = [], dict.fromkeys(counts, 0), 0
    for many, items in zip(number, filled):
        offset = 0
        for length, copies in items if many else ():
            runs.append((length, rank[length], rank[length] + many * copies, copies, first, offset))
            rank[length] += many * copies
            offset += length * copies
        first += many
    return runs


def pack(docs: DataFrame, tokenizer: tuple[str, str, str], stage: Stage, **limits) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Tokens stay where they are made: pieces are small rows, counted by length; the plan comes from the counts (at
    most one per length up to the size of a sequence, so the plan is bounded too), and a piece finds its place by its
    rank among those of its length. Ranks are cut by hash, so a length that a third of all pieces share is ordered
    in many tasks.

    A null or empty text is the single END token; repeated rows and ids are packed each; null ids are kept; other
    columns are ignored; no rows give no rows.
    """
    size = limits.get("size", SIZE)
    cut = stage.write(pieces(docs, tokenizer, size), "pieces")
    parts = max(16, cut.count() // 65_536)
    placed = cut.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = placed.groupBy("length", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stage.write(counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))), "offsets")
    total = {r["length"]: r["n"] for r in offsets.groupBy("length").agg(F.sum("_n").alias("n")).collect()}
    spark = docs.sparkSession
    plan = spark.createDataFrame(best_fit(total, **limits), "length long, _lo long, _hi long, _copies long, _first long, _offset long")
    inner = Window.partitionBy("length", "_part").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = placed.withColumn("_row", F.row_number().over(inner) - 1).join(offsets, ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_row"))
    found = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("_rank") >= F.col("_lo")) & (F.col("_rank") < F.col("_hi"))).drop(plan["length"])
    step = F.col("_rank") - F.col("_lo")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("_first") + F.floor(step / F.col("_copies"))).alias("sequence_id"),
        (F.col("_offset") + step % F.col("_copies") * F.col("length")).alias("offset"))
