"""Quality rules: rule statistics of whole texts and an isolation forest over them, calibrated by labels."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from photospark.llm import kernels as K
from photospark.llm.stage import Stage

SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
EXTRA = ["n_upper", "n_letters", "n_marks", "n_distinct", "n_lines"]
FEATURES = ["symbol_share", "dup_share", "repeat_share", "upper_share", "mark_share", "distinct_share", "word_length"]
TREES, SAMPLE, DEPTH = 100, 256, 8


def statistics_of(column: pa.Array) -> dict[str, np.ndarray]:
    """COUNTS and EXTRA of each text (null: none)."""
    out = {c: np.zeros(len(column), np.int64) for c in COUNTS + EXTRA}
    for lo, hi, data, offsets in K.chunks(column):
        words = K.Words(data, offsets)
        n = np.diff(words.first)
        inside = np.zeros(len(data) + 1, np.int64)

        def per_text(flags: np.ndarray) -> np.ndarray:
            np.cumsum(flags, out=inside[1:])
            return inside[offsets[1:]] - inside[offsets[:-1]]

        head = (data & 0xC0) != 0x80
        out["n_words"][lo:hi] = n
        out["word_chars"][lo:hi] = per_text(head & ~K.SEPARATOR[data])
        out["n_symbols"][lo:hi] = per_text(SYMBOLS[data])
        upper = (data >= 65) & (data <= 90)
        out["n_upper"][lo:hi] = per_text(upper)
        out["n_letters"][lo:hi] = per_text(upper | ((data >= 97) & (data <= 122)))
        out["n_marks"][lo:hi] = per_text((data == 33) | (data == 63))
        lines, dups = _lines(data, offsets, words)
        out["n_lines"][lo:hi], out["n_dup_lines"][lo:hi] = lines, dups
        runs = K.windows(words, 3)
        for i, (a, b) in enumerate(zip(words.first[:-1].tolist(), words.first[1:].tolist())):
            if b > a:
                out["n_distinct"][lo + i] = len(np.unique(words.hash[a:b]))
            if b - a >= 4:
                out["n_repeat_words"][lo + i] = _covered(runs[a:b - 2], 3)
    return out


def _covered(runs: np.ndarray, size: int) -> int:
    """Words that lie in a window whose hash occurs twice or more."""
    order = np.argsort(runs, kind="stable")
    same = runs[order][1:] == runs[order][:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(runs), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    marked = np.zeros(len(runs) + size - 1, bool)
    for j in range(size):
        marked[j:j + len(runs)] |= twice
    return int(marked.sum())


def _lines(data: np.ndarray, offsets: np.ndarray, words: K.Words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those among them whose whole content equals an earlier one, per text."""
    cuts = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    cuts = cuts[cuts < max(len(data), 1)]
    ends = np.append(cuts[1:], len(data))
    breaks = np.zeros(len(data) + 1, bool)
    breaks[:len(data)] = data == 10
    ends = ends - breaks[np.maximum(ends - 1, 0)] * (ends > cuts)
    has = np.searchsorted(words.start, ends) > np.searchsorted(words.start, cuts)
    cuts, ends = cuts[has], ends[has]
    power, inverse = K._powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(K._BYTE[data] * power[:len(data)], out=total[1:])
    key = K.mix((total[ends] - total[cuts]) * inverse[cuts] + (ends - cuts).astype(np.uint64))
    text = np.searchsorted(offsets, cuts, "right") - 1
    order = np.lexsort((key, text))
    again = (key[order][1:] == key[order][:-1]) & (text[order][1:] == text[order][:-1])
    n = len(offsets) - 1
    return np.bincount(text, minlength=n), np.bincount(text[order][1:][again], minlength=n)


def rule_statistics(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row of counts per document, in one pass over whole texts."""
    names = [id_col, *COUNTS, *EXTRA]

    def measure(batches):
        for batch in batches:
            stats = statistics_of(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(stats[c]) for c in COUNTS + EXTRA]], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, "text").mapInArrow(measure, f"{id_col} {kind}, " + ", ".join(f"{c} long" for c in COUNTS + EXTRA))


#: What each rule tolerates; a statistic counts by what lies beyond.
TOLERATED = {"symbol_share": 0.02, "dup_share": 0.3, "repeat_share": 0.2, "upper_share": 0.3, "mark_share": 0.1, "distinct_share": 0.3, "word_length": (3.0, 12.0)}


def with_features(stats: DataFrame, tolerated: dict = TOLERATED) -> DataFrame:
    """How far the statistics go beyond their rules, as shares that don't depend on the length of a text."""
    words, chars = F.greatest("n_words", F.lit(1)), F.greatest("word_chars", F.lit(1))
    shortest, longest = tolerated["word_length"]
    length = chars / words
    over = {
        "symbol_share": F.col("n_symbols") / chars, "dup_share": F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words, "upper_share": F.col("n_upper") / F.greatest("n_letters", F.lit(1)),
        "mark_share": F.col("n_marks") / words}
    cols = {n: F.greatest(c - tolerated[n], F.lit(0.0)) for n, c in over.items()}
    cols["distinct_share"] = F.greatest(tolerated["distinct_share"] - F.col("n_distinct") / F.pow(words, 0.85), F.lit(0.0))
    cols["word_length"] = F.greatest(length - longest, shortest - length, F.lit(0.0))
    return stats.withColumns({n: cols[n].cast("double") for n in FEATURES})


def grow_tree(rows: np.ndarray, seed: int) -> dict[str, np.ndarray]:
    """An isolation tree: random feature, random split between its extremes, to a depth of DEPTH; leaves hold path lengths."""
    rng = np.random.Generator(np.random.PCG64(seed))
    feature, split, left, right, path = [], [], [], [], []

    def node(part: np.ndarray, depth: int) -> int:
        at = len(feature)
        feature.append(-1), split.append(0.0), left.append(at), right.append(at), path.append(depth + _average_path(len(part)))
        spread = np.flatnonzero(part.max(0) > part.min(0)) if len(part) > 1 else []
        if depth < DEPTH and len(spread):
            f = int(rng.choice(spread))
            feature[at], split[at] = f, float(rng.uniform(part[:, f].min(), part[:, f].max()))
            low = part[:, f] < split[at]
            left[at], right[at] = node(part[low], depth + 1), node(part[~low], depth + 1)
        return at

    node(rows, 0)
    return {"feature": np.array(feature), "split": np.array(split), "left": np.array(left), "right": np.array(right), "path": np.array(path)}


def _average_path(n: int) -> float:
    """Mean path of an unsuccessful search in a random tree of n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def path_lengths(rows: np.ndarray, trees: list[dict[str, np.ndarray]]) -> np.ndarray:
    total = np.zeros(len(rows))
    line = np.arange(len(rows))
    for t in trees:
        at = np.zeros(len(rows), np.int64)
        for _ in range(DEPTH):
            f = t["feature"][at]
            low = rows[line, np.maximum(f, 0)] < t["split"][at]
            at = np.where(f < 0, at, np.where(low, t["left"][at], t["right"][at]))
        total += t["path"][at]
    return total / max(1, len(trees))


def fit_forest(features: DataFrame, id_col: str, trees: int = TREES) -> list[dict[str, np.ndarray]]:
    """The method's own subsamples (``trees`` x SAMPLE rows of least hash), one tree per group in a Spark task.

    The driver gets the trees only: at most ``trees`` x 2**(DEPTH + 1) nodes.
    """
    order = F.xxhash64(F.col(id_col), F.lit("forest"))
    sample = features.select(F.struct(order.alias("o"), *FEATURES).alias("s")).orderBy("s").limit(trees * SAMPLE)
    cut = sample.select(F.pmod(F.col("s.o"), F.lit(trees)).cast("int").alias("tree"), "s.*")

    def grow(part: pd.DataFrame) -> pd.DataFrame:
        t = grow_tree(part.sort_values("o")[FEATURES].to_numpy(), int(part["tree"].iloc[0]))
        return pd.DataFrame({"tree": int(part["tree"].iloc[0]), **{k: [v.tolist()] for k, v in t.items()}})

    kinds = "tree int, feature array<long>, split array<double>, left array<long>, right array<long>, path array<double>"
    found = cut.groupBy("tree").applyInPandas(grow, kinds).orderBy("tree").toArrow().to_pylist()
    return [{k: np.array(r[k]) for k in ("feature", "split", "left", "right", "path")} for r in found]


def with_score(features: DataFrame, trees: list[dict[str, np.ndarray]]) -> DataFrame:
    """Adds ``anomaly`` in (0, 1]: 2 ** (-mean path / expected path); higher is odder."""
    norm = _average_path(SAMPLE)

    @F.pandas_udf("double")
    def anomaly(*columns: pd.Series) -> pd.Series:
        rows = np.column_stack([c.to_numpy() for c in columns])
        return pd.Series(np.round(2.0 ** (-path_lengths(rows, trees) / norm), 9)) if trees else pd.Series(np.zeros(len(rows)))

    return features.withColumn("anomaly", anomaly(*FEATURES))


def calibrate(scored: DataFrame, labels: DataFrame, id_col: str, max_loss: float = 0.005) -> float:
    """The threshold that catches most rows labelled bad while it rejects at most ``max_loss`` of those labelled good.

    All labelled rows that pass the base count. Of equal thresholds the most lenient one is taken. Scores are
    counted in 10,000 steps, so the driver sees a bounded histogram. Without bad rows: 1 (keep all).
    """
    steps = scored.where("NOT base_failed").join(labels.select(id_col, "quality"), id_col).groupBy(F.ceil(F.col("anomaly") * 10000).cast("int").alias("step")).agg(
        F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("quality") == 0).alias("bad")).collect()
    total, lost, caught, best, most = sum(r["good"] for r in steps), 0, 0, 1.0, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        lost, caught = lost + r["good"], caught + r["bad"]
        if lost > max_loss * total:
            break
        if caught > most:
            best, most = (r["step"] - 1) / 10000, caught
    return best


def judge(docs: DataFrame, labels: DataFrame, stage: Stage, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts, base_failed, anomaly, threshold, kept.

    Base rules: fewer than 50 words, or more than half of the words in repeated 3-word windows. The forest learns
    from documents that pass them and judges those. A null or empty text has no words and fails the base; null
    ids are judged like others; repeated rows are judged alike, each; no rows give no rows; without labels all
    that pass the base are kept; other columns are ignored.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stage.write(with_features(rule_statistics(docs, id_col)).withColumn("base_failed", failed), "statistics")
    trees = fit_forest(stats.where("NOT base_failed"), id_col)
    scored = with_score(stats, trees)
    threshold = calibrate(scored, labels, id_col)
    return scored.select(id_col, *COUNTS, "base_failed", "anomaly", F.lit(threshold).alias("threshold"),
                         (~F.col("base_failed") & (F.col("anomaly") <= threshold)).alias("kept"))


def kept_rows(docs: DataFrame, labels: DataFrame, stage: Stage, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their columns, whatever their ids are.

    Forest and threshold come from the table of statistics as in ``judge``; then the text of every row is measured where
    it is read, so the verdict stays with the row: rows that share an id, and rows without one, are judged each by their own text,
    and no text is shuffled. Columns must not be named like the statistics.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    stats = stage.write(with_features(rule_statistics(docs, id_col)).withColumn("base_failed", failed), "statistics")
    trees = fit_forest(stats.where("NOT base_failed"), id_col)
    threshold = calibrate(with_score(stats, trees), labels, id_col)
    stage.drop("statistics")
    names = [*docs.columns, *COUNTS, *EXTRA]

    def measure(batches):
        for batch in batches:
            own = statistics_of(batch.column(batch.schema.get_field_index("text")))
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(own[c]) for c in COUNTS + EXTRA]], names=names)

    schema = reduce(lambda s, c: s.add(c, "long"), COUNTS + EXTRA, StructType(list(docs.schema.fields)))
    passed = with_features(docs.mapInArrow(measure, schema)).where(~failed)
    return with_score(passed, trees).where(F.col("anomaly") <= threshold).select(*docs.columns)
