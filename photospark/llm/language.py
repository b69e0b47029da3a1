"""Language identification with hyperdimensional profiles of letter n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE, GRAM = 512, 3
UNKNOWN = "und"
_SEED = np.uint64(20240602)
_letters: dict[int, np.ndarray] = {}


def letter_vector(code: int) -> np.ndarray:
    """Random +1/-1 vector of a letter, the same in every task."""
    if code not in _letters:
        bits = np.random.Generator(np.random.PCG64([int(_SEED), code])).integers(0, 2, SIZE)
        _letters[code] = (bits * 2 - 1).astype(np.int8)
    return _letters[code]


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """Bind the letters of each n-gram (rows of code points), each permuted by its place: elementwise product of rolled vectors."""
    codes, back = np.unique(grams, return_inverse=True)
    table = np.stack([letter_vector(int(c)) for c in codes])
    back = back.reshape(grams.shape)
    out = table[back[:, GRAM - 1]]
    for place in range(GRAM - 1):
        out = out * np.roll(table, GRAM - 1 - place, axis=1)[back[:, place]]
    return out


def letters_of(text: str) -> np.ndarray:
    """Code points of the lower-cased text; runs of anything but letters become one 0, also at both ends; empty without a letter."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(codes):
        return codes
    distinct, back = np.unique(codes, return_inverse=True)
    kept = np.array([c if chr(c).isalpha() else 0 for c in distinct.tolist()], np.uint32)[back]
    if not kept.any():
        return kept[:0]
    kept = np.concatenate([np.zeros(1, np.uint32), kept, np.zeros(1, np.uint32)])
    return kept[np.concatenate([[True], (kept[1:] != 0) | (kept[:-1] != 0)])]


def bundles(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(unit document vectors, has letters): the bundled n-gram vectors of each text.

    N-gram vectors are bound once per batch part and weighted by their count in a text.
    """
    out, known = np.zeros((len(texts), SIZE), np.float32), np.zeros(len(texts), bool)
    part: list[tuple[int, np.ndarray]] = []
    held = 0

    def flush() -> None:
        codes, back = np.unique(np.concatenate([k for _, k in part]), return_inverse=True)
        grams = np.stack([(codes >> np.uint64(42)), (codes >> np.uint64(21)) & np.uint64(0x1FFFFF), codes & np.uint64(0x1FFFFF)], 1).astype(np.uint32)
        table, at = gram_vectors(grams).astype(np.float32), 0
        for i, k in part:
            spots, counts = np.unique(back[at:at + len(k)], return_counts=True)
            at += len(k)
            v = counts.astype(np.float32) @ table[spots]
            size = float(np.sqrt(v @ v))
            out[i], known[i] = (v / size if size else v), True

    for i, text in enumerate(texts):
        codes = letters_of(text or "").astype(np.uint64)
        if len(codes) < GRAM:
            continue
        part.append((i, (codes[:-2] << np.uint64(42)) | (codes[1:-1] << np.uint64(21)) | codes[2:]))
        held += len(codes)
        if held > 200_000:
            flush()
            part.clear()
            held = 0
    if part:
        flush()
    return out, known


def fit_prototypes(docs: DataFrame, per_language: int = 20_000) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) from (doc_id, text, lang): the bundle of document vectors of each language.

    Each language is learned from about ``per_language`` documents of least hash (all, if it has fewer), the
    documented size of the sample. Tasks send one vector per language; sums are made in Spark. The mean of the
    prototypes, what all languages share, is taken off.
    """
    rows = docs.where("lang IS NOT NULL").select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return [], np.zeros((0, SIZE))
    share = F.create_map(*[F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, per_language / n))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit("prototype")), F.lit(1_000_000)) / 1_000_000
    sample = rows.where(draw < F.element_at(share, F.col("lang"))).select("lang", "text")

    def bundle(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            vectors, _ = bundles(batch.column(1).to_pylist())
            langs = np.array(batch.column(0).to_pylist(), object)
            for lang in set(langs):
                total[lang] = total.get(lang, np.zeros(SIZE)) + vectors[langs == lang].sum(0, dtype=np.float64)
        if total:
            names = list(total)
            flat = np.round(np.concatenate([total[k] for k in names]) * 1e6).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, SIZE)), pa.array(np.tile(np.arange(SIZE, dtype=np.int32), len(names))), pa.array(flat)], names=["lang", "place", "value"])

    sums = sample.mapInArrow(bundle, "lang string, place int, value long").groupBy("lang", "place").agg(F.sum("value").alias("value")).toPandas()
    table = sums.pivot(index="lang", columns="place", values="value").sort_index().fillna(0)
    protos = table.to_numpy(np.float64)
    protos /= np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)
    if len(protos) > 1:
        protos -= protos.mean(0)
        protos /= np.maximum(np.linalg.norm(protos, axis=1, keepdims=True), 1e-12)
    return list(table.index), protos


def predict(docs: DataFrame, languages: list[str], prototypes: np.ndarray) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (softmax share of the best cosine).

    A text that is null, empty or without letters, and every text if nothing was learned, is ``und`` with score
    0; ties go to the first name; repeated rows and null ids are predicted like others; other columns are ignored.
    """
    protos = prototypes.astype(np.float32)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def label(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            vectors, known = bundles(texts)
            names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if len(languages) and len(texts):
                near = (vectors @ protos.T).astype(np.float64)
                grown = np.exp(12 * (near - near.max(1, keepdims=True)))
                best = near.argmax(1)
                names[known] = np.array(languages, object)[best[known]]
                score[known] = (grown.max(1) / grown.sum(1))[known]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(np.round(score, 6))], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(label, f"doc_id {kind}, lang_pred string, score double")
