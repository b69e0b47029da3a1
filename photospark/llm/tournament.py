"""First-fit decreasing packing with a tournament tree of bin capacities, in randomised groups of documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from photospark.llm.packing import Encoder
from photospark.llm.stage import Stage

END, SIZE, GROUP = 0, 1024, 2048
PIECES = "array<struct<doc_id:{kind},start:bigint,length:bigint,offset:bigint,doc_tokens:bigint>>"


def first_fit(lengths: list[int], size: int = SIZE) -> list[list[int]]:
    """First-fit decreasing: the items of each bin, in the order in which they were put.

    The leaves of the tree are the room left in the bins, an inner node is the larger of its two children. The way
    down from the root that prefers the left child wherever it has room enough ends at the first bin that fits.
    Items of equal length keep their order.
    """
    leaves = 1
    while leaves < len(lengths):
        leaves *= 2
    room = [size] * (2 * leaves)
    bins: list[list[int]] = []
    for item in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        need, at = lengths[item], 1
        if need > size:
            raise ValueError(f"an item of {need} tokens is longer than a sequence")
        while at < leaves:
            at *= 2
            if room[at] < need:
                at += 1
        if at - leaves == len(bins):
            bins.append([])
        bins[at - leaves].append(item)
        room[at] -= need
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
    return bins


def fill(bins: list[list[int]], lengths: list[int], size: int = SIZE) -> list[list[tuple[int, int, int]]]:
    """Bins as lists of (item, start, length) in which the emptiest ones were cut up to fill what is left in the others.

    At most one bin stays short of ``size``; it is cut into sequences whose lengths are powers of two, which need no
    padding. Only items of the emptiest bins are cut.
    """
    held = sorted(([(k, 0, lengths[k]) for k in own] for own in bins), key=lambda own: -sum(p[2] for p in own))
    used = [sum(p[2] for p in own) for own in held]
    into, out = 0, len(held) - 1
    while into < out:
        gap = size - used[into]
        if not gap:
            into += 1
            continue
        item, start, length = held[out].pop()
        take = min(gap, length)
        held[into].append((item, start + length - take, take))
        used[into], used[out] = used[into] + take, used[out] - take
        if take < length:
            held[out].append((item, start, length - take))
        elif not held[out]:
            out -= 1
    full = [own for own, n in zip(held, used) if n == size]
    for own in (own for own, n in zip(held, used) if 0 < n < size):
        pieces, left = own[::-1], sum(p[2] for p in own)
        while left:
            want, part = 1 << (left.bit_length() - 1), []
            left -= want
            while want:
                item, start, length = pieces.pop()
                take = min(want, length)
                part.append((item, start, take))
                want -= take
                if take < length:
                    pieces.append((item, start + take, length - take))
            full.append(part)
    return full


def cut_documents(docs: DataFrame, tokenizer: tuple[str, str, str], size: int = SIZE) -> DataFrame:
    """(doc_id, doc_tokens, start, length, whole, rest): ids of a text plus END, in pieces of ``size`` and a shorter rest.

    The ids (little-endian 32-bit words) are in ``whole`` for a full piece and in ``rest`` for a shorter one, so that a
    reader of one kind doesn't fetch the other.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def cut(batches):
        encoder = Encoder(tokenizer)
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                index, tokens, start, length, whole, rest = [], [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    ids = encoder.encode(text) + END.to_bytes(4, "little")
                    n = len(ids) // 4
                    for at in range(0, n, size):
                        piece = ids[4 * at:4 * (at + size)]
                        index.append(row), tokens.append(n), start.append(at), length.append(len(piece) // 4)
                        whole.append(piece if len(piece) == 4 * size else None), rest.append(None if len(piece) == 4 * size else piece)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(index, pa.int64())), *[pa.array(c, pa.int64()) for c in (tokens, start, length)], pa.array(whole, pa.binary()), pa.array(rest, pa.binary())],
                    names=["doc_id", "doc_tokens", "start", "length", "whole", "rest"])

    return docs.select("doc_id", "text").mapInArrow(cut, f"doc_id {kind}, doc_tokens long, start long, length long, whole binary, rest binary")


def pack(docs: DataFrame, tokenizer: tuple[str, str, str], stage: Stage, size: int = SIZE, group: int = GROUP, seed: int = 5) -> DataFrame:
    """Sequences of token ids: sequence_id, length, padded, tokens (little-endian 32-bit words), pieces.

    Full pieces of a document are sequences of their own and stay where they are made. The rests, at most one per
    document and each under ``size``, are dealt at random to groups of about ``group``; every group is packed by itself in a
    task: first-fit decreasing, then the gaps are filled by cutting the emptiest sequences. ``padded`` is the length with
    padding: ``size``, or the length itself where it is a power of two.

    A null or empty text is the single END token. Repeated rows and ids are packed each, null ids are kept, other
    columns are ignored; no rows give no rows. A random number written with each rest makes the groups, so a text
    that fills a third of the table is spread over all groups.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    cut = stage.write(cut_documents(docs, tokenizer, size).withColumns({"deal": F.rand(seed), "number": F.monotonically_increasing_id()}), "pieces")
    rests = cut.where(F.col("length") < size)
    groups = max(1, -(-rests.count() // group))

    def pack_group(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("number")
        first, base = table["start"].to_pylist(), key[0].as_py() << 32
        tokens, lengths = table["rest"].to_pylist(), table["length"].to_pylist()
        made = fill(first_fit(lengths, size), lengths, size)
        flat = [piece for own in made for piece in own]
        item, start, length = (np.array(c, np.int64) for c in zip(*flat))
        bounds = np.concatenate([[0], np.cumsum([len(own) for own in made])])
        before = np.cumsum(length) - length
        offset = before - np.repeat(before[bounds[:-1]], np.diff(bounds))
        ids = table["doc_id"].combine_chunks().take(pa.array(item))
        inner = pa.StructArray.from_arrays(
            [ids, pa.array(np.array(first, np.int64)[item] + start), pa.array(length), pa.array(offset), table["doc_tokens"].combine_chunks().take(pa.array(item))],
            names=["doc_id", "start", "length", "offset", "doc_tokens"])
        joined = [b"".join(tokens[k][4 * a:4 * (a + n)] for k, a, n in own) for own in made]
        return pa.table({
            "sequence_id": pa.array([2 * (base + k) + 1 for k in range(len(made))], pa.int64()), "length": pa.array([len(t) // 4 for t in joined], pa.int64()),
            "tokens": pa.array(joined, pa.binary()), "pieces": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), inner)})

    dealt = rests.select(F.floor(F.col("deal") * groups).alias("group"), "number", "doc_id", "doc_tokens", "start", "length", "rest")
    packed = dealt.groupBy("group").applyInArrow(pack_group, f"sequence_id long, length long, tokens binary, pieces {PIECES.format(kind=kind)}")
    alone = F.array(F.struct("doc_id", "start", "length", F.lit(0).cast("long").alias("offset"), "doc_tokens")).cast(PIECES.format(kind=kind))
    full = cut.where(F.col("length") == size).select((2 * F.col("number")).alias("sequence_id"), "length", F.col("whole").alias("tokens"), alone.alias("pieces"))
    return full.unionByName(packed).select("sequence_id", "length", padded(F.col("length"), size).alias("padded"), "tokens", "pieces")


def padded(length: Column, size: int = SIZE) -> Column:
    """Length with padding: a power of two needs none."""
    return F.when(length.bitwiseAND(length - 1) == 0, length).otherwise(F.lit(size)).cast("long")


def digest(sequences: DataFrame) -> DataFrame:
    """One row per piece, read back from the sequences: its document, place, and the CRC-32 of the ids that stand there."""
    one = sequences.select("sequence_id", "tokens", F.explode("pieces").alias("p")).select("p.*", "sequence_id", "tokens")
    there = F.substring("tokens", 4 * F.col("offset") + 1, 4 * F.col("length"))
    return one.select("doc_id", "start", "length", F.crc32(there).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
