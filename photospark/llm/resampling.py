"""Importance resampling of documents towards a target text: hashed word runs, position-table CRC, Gumbel top share."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from photospark.llm import kernels as K
from photospark.llm.stage import Stage
from photospark.operators.quantiles import global_rank

BUCKETS = 10_000
#: Distances from the end of a span that the table covers; longer spans are folded in blocks of this many bytes.
REACH = 256
#: Bytes handled at a time inside a text.
STEP = 1 << 20
LIVE = np.zeros(256, bool)
LIVE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def position_table(reach: int = REACH) -> np.ndarray:
    """``table[d, b]``: what byte b adds to the CRC-32 of a span that ends d bytes after it (the register starts at 0)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, (step >> 1) ^ np.uint32(0xEDB88320), step >> 1)
    table = np.empty((reach, 256), np.uint32)
    table[0] = step
    for d in range(1, reach):
        table[d] = step[table[d - 1] & 0xFF] ^ (table[d - 1] >> 8)
    return table


TABLE = position_table()
#: The CRC-32 of as many zero bytes: what the length alone adds.
CONSTANT = np.array([zlib.crc32(bytes(n)) for n in range(REACH + 1)], np.uint32)


def span_crc(data: np.ndarray, lengths: np.ndarray, ahead: np.ndarray | int = 0) -> np.ndarray:
    """Linear part of the CRC of consecutive spans of ``data``, each followed by ``ahead`` more bytes (in all at most REACH)."""
    if not len(lengths):
        return np.zeros(0, np.uint32)
    ends = np.cumsum(lengths)
    distance = np.repeat(ends - 1 + ahead, lengths) - np.arange(len(data))
    return np.bitwise_xor.reduceat(TABLE[distance, data], ends - lengths)


def long_crc(parts: list[np.ndarray]) -> int:
    """CRC-32 of a span of more than REACH bytes, given in parts: the values of its blocks, folded from the front.

    The start value 0xFFFFFFFF is the same as four inverted first bytes. A fold carries a value over one block, as
    if its four bytes stood at the head of that block.
    """
    data = np.concatenate(parts)
    data[:4] ^= 0xFF
    state, at, step = 0, 0, len(data) % REACH or REACH
    while at < len(data):
        end = min(len(data), at + step + (STEP // REACH) * REACH)
        sizes = np.full((end - at - step) // REACH + 1, REACH)
        sizes[0] = step
        for value, size in zip(span_crc(data[at:end], sizes).tolist(), sizes.tolist()):
            if at or state:
                for j in range(4):
                    value ^= int(TABLE[size - 1 - j, (state >> 8 * j) & 0xFF])
            state = value
            at += size
        step = REACH
    return state ^ 0xFFFFFFFF


def _spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of the words and the number of the first word of each text."""
    live = LIVE[data]
    left, right = np.zeros(len(data), bool), np.zeros(len(data), bool)
    left[1:], right[:-1] = live[:-1], live[1:]
    left[offsets[:-1][offsets[:-1] < len(data)]] = False
    right[offsets[1:][offsets[1:] > 0] - 1] = False
    start = np.flatnonzero(live & ~left)
    return start, np.flatnonzero(live & ~right) + 1, np.searchsorted(start, offsets)


def run_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """CRC-32 of each word, and of each word with its successor joined by one space (the last word has none)."""
    size = end - start
    pair = size[:-1] + 1 + size[1:]
    short = np.where(size > REACH, 0, size)
    body = np.arange(short.sum()) + np.repeat(start - (np.cumsum(short) - short), short)
    low, full = K.LOWER[data[body]], short > 0
    single, double = np.zeros(len(size), np.uint32), np.zeros(len(pair), np.uint32)
    linear = np.zeros(len(size), np.uint32)
    linear[full] = span_crc(low, short[full])
    single[full] = linear[full] ^ CONSTANT[short[full]]
    fits = np.flatnonzero(pair <= REACH)
    if len(fits):
        heads = np.zeros(len(size), bool)
        heads[fits] = True
        first, ahead = low[np.repeat(heads, short)], 1 + size[1:][fits]
        double[fits] = span_crc(first, short[fits], ahead) ^ TABLE[size[1:][fits], 32] ^ linear[fits + 1] ^ CONSTANT[pair[fits]]
    blank = np.array([32], np.uint8)

    def word(k: int) -> np.ndarray:
        return K.LOWER[data[start[k]:end[k]]]

    for k in np.flatnonzero(size > REACH).tolist():
        single[k] = long_crc([word(k)])
    for k in np.flatnonzero(pair > REACH).tolist():
        double[k] = long_crc([word(k), blank, word(k + 1)])
    return single, double


def buckets_of(column: pa.Array, many: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(texts, words of each, bucket and text of every feature) in steps; a long text comes in several steps.

    A step gives (text of each word counted, bucket of each feature, text of each feature); a word is counted once.
    """
    for lo, _, data, offsets in K.chunks(column):
        start, end, first = _spans(data, offsets)
        owner = np.repeat(np.arange(lo, lo + len(offsets) - 1), np.diff(first))
        cut = np.unique(np.concatenate([[0], np.searchsorted(start, np.arange(STEP, len(data), STEP)), [len(start)]]))
        for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
            last = min(b + 1, len(start))  # the pair that crosses the step belongs to it
            single, double = run_hashes(data, start[a:last], end[a:last])
            pairs = np.flatnonzero(owner[a:last - 1] == owner[a + 1:last])
            yield owner[a:b], np.concatenate([single[:b - a], double[pairs]]) % np.uint32(many), np.concatenate([owner[a:b], owner[a:last - 1][pairs]])


def bucket_counts(texts: DataFrame, text: str = "text", many: int = BUCKETS) -> np.ndarray:
    """Features per bucket over all rows: tasks send one count per bucket they met, Spark adds them up; ``many`` numbers are collected."""
    def count(batches):
        total = np.zeros(many, np.int64)
        for batch in batches:
            for _, bucket, _ in buckets_of(batch.column(0), many):
                total += np.bincount(bucket, minlength=many)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    rows = texts.select(F.col(f"`{text}`")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(many, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of each bucket in thousandths: floor(1000 * ln of the ratio of its smoothed shares in target and source)."""
    many, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(all_s + many) / (float(s + 1) * float(all_t + many)))) for s, t in zip(source.tolist(), target.tolist())], np.int64)


def noise(key: str) -> int:
    """Gumbel noise in thousandths, from the first 32 bits of the SHA-256 of a key."""
    h = int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gains: np.ndarray, seed: int = 7) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every row, from its whole text."""
    kind, many = docs.schema["doc_id"].dataType.simpleString(), len(gains)

    def measure(batches):
        for batch in batches:
            words, features, total = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for own, bucket, text in buckets_of(batch.column(1), many):
                words += np.bincount(own, minlength=len(words))
                features += np.bincount(text, minlength=len(words))
                np.add.at(total, text, gains[bucket])
            weight = total // np.maximum(features, 1)
            drawn = np.array([noise(f"{seed}:{'' if i is None else i}") for i in batch.column(0).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (words, features, weight, weight + drawn))], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select("doc_id", "text").mapInArrow(measure, f"doc_id {kind}, n_words long, n_features long, weight long, score long")


def resample(docs: DataFrame, target: DataFrame, stage: Stage, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """Every document with n_words, n_features, weight, score and its rank among the drawn (null: not drawn).

    Both corpora are counted whole, in ``buckets`` classes of the CRC-32 of runs of one and two words. Of the
    documents with ``least_words`` words or more ``percent`` hundredths are drawn without replacement: the highest
    sums of weight and Gumbel noise. Only counts per bucket reach the driver; ranks come from a range sort.

    A null or empty text and a text without words have no feature, weight 0 and are never drawn. Equal scores go to the
    smaller doc_id, a null one last; its noise is that of an empty id. Repeated rows are weighed and drawn each. No
    rows give no rows; an empty target leaves the gains of rare buckets. Other columns are ignored.
    """
    gains = gains_of(bucket_counts(docs, many=buckets), bucket_counts(target, many=buckets))
    rows = stage.write(weigh(docs, gains, seed), "weights")
    enough = F.col("n_words") >= least_words
    wanted = percent * rows.where(enough).count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features"), F.col("_salt")]
    ranked = global_rank(rows.where(enough).withColumn("_salt", F.rand(seed)), order).drop("_salt")
    place = F.when(F.col("rank") <= wanted, F.col("rank")).cast("long")
    return ranked.withColumn("rank", place).unionByName(rows.where(~enough).withColumn("rank", F.lit(None).cast("long")))
