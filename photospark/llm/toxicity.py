"""Toxicity by a weighted finite-state grammar over clauses: cue transducers, composed clause patterns, learned weights."""

from __future__ import annotations

import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W_]+")
CLAUSE = re.compile(r"[.!?;:\n]")

# Cue words of the grammar.
THREAT = "kill hurt destroy beat shoot stab burn attack punish töten schlagen tuer frapper detruire matar golpear".split()
TARGET = "you your he she him her they them people du dich ihr sie tu te vous toi lui tú usted ellos ella".split()
NEGATION = "not no never neither nor none without kein keine nicht nie niemals pas jamais aucun sin nunca jamás".split()
REPORT = "said says wrote quoted reported claimed called sagte schrieb zitierte dit disait écrit cité dijo escribió citó".split()

#: Output patterns of the clause grammar and their prior chance of a toxic text, worth PRIOR labelled texts.
PATTERNS = {"insult": 0.8, "insult at target": 0.9, "threat at target": 0.5, "threat": 0.1, "negated insult": 0.4, "reported insult": 0.4}
PRIOR = 4.0

#: The clause transducer. A state keeps what still bears on the next word; (state, cue) -> (state, pattern or "").
ARCS = {
    ("", "N"): ("N", ""), ("", "R"): ("R", ""), ("", "Y"): ("Y", ""), ("", "I"): ("I", "insult"), ("", "T"): ("T", "threat"),
    ("Y", "N"): ("N", ""), ("Y", "R"): ("R", ""), ("Y", "Y"): ("Y", ""), ("Y", "I"): ("I", "insult at target"), ("Y", "T"): ("T", "threat"),
    ("N", "N"): ("N", ""), ("N", "R"): ("R", ""), ("N", "Y"): ("N", ""), ("N", "I"): ("I", "negated insult"), ("N", "T"): ("", ""),
    ("R", "N"): ("R", ""), ("R", "R"): ("R", ""), ("R", "Y"): ("R", ""), ("R", "I"): ("I", "reported insult"), ("R", "T"): ("R", ""),
    ("T", "N"): ("N", ""), ("T", "R"): ("R", ""), ("T", "Y"): ("Y", "threat at target"), ("T", "I"): ("I", "insult"), ("T", "T"): ("T", "threat"),
    ("I", "N"): ("N", ""), ("I", "R"): ("R", ""), ("I", "Y"): ("Y", "insult at target"), ("I", "I"): ("I", "insult"), ("I", "T"): ("T", "threat"),
}


class Grammar:
    """Cue transducer (words to cues) composed with the clause transducer (cues to patterns).

    ``words`` are insults as whole words, ``stems`` as beginnings of words. A cue bears on the next ``reach`` words.
    """

    def __init__(self, words: list[str], stems: list[str], reach: int = 6):
        self.cues = {w: k for k, ws in (("T", THREAT), ("Y", TARGET), ("N", NEGATION), ("R", REPORT)) for w in ws}
        self.cues |= dict.fromkeys(words, "I")
        self.stems, self.reach = tuple(stems), reach
        self.seeds = ahocorasick.Automaton()
        for x in [*words, *stems, *THREAT]:
            self.seeds.add_word(x, 1)
        self.seeds.make_automaton()

    def cue(self, word: str) -> str:
        return self.cues.get(word) or ("I" if self.stems and word.startswith(self.stems) else "")

    def patterns(self, text: str) -> dict[str, int]:
        """Counts of the patterns in the clauses of a text; only clauses around a seed are read."""
        text, found, done = text.lower(), {}, -1
        for at, _ in self.seeds.iter(text):
            if at < done:
                continue
            lo = 0
            for mark in ".!?;:\n":
                lo = max(lo, text.rfind(mark, done if done > 0 else 0, at) + 1)
            end = CLAUSE.search(text, at)
            done = end.start() if end else len(text)
            for pattern in self.run(WORD.findall(text, max(lo, 0), done)):
                found[pattern] = found.get(pattern, 0) + 1
        return found

    def run(self, words: list[str]) -> list[str]:
        state, age, out = "", 0, []
        for word in words:
            cue, age = self.cue(word), age + 1
            if age > self.reach:
                state = ""
            if cue:
                state, pattern = ARCS[state, cue]
                age = 0
                if pattern:
                    out.append(pattern)
        return out


def score_of(found: dict[str, int], weights: dict[str, float], base: float) -> float:
    """Noisy-or of the matched clauses; the base rate of texts without a match is the floor."""
    free = 1.0 - base
    for pattern, n in found.items():
        free *= (1.0 - weights[pattern]) ** min(n, 50)
    return 1.0 - free


def learn_insults(taught: DataFrame, min_toxic: int = 3, precision: float = 0.85, sure: float = 0.95, longest: int = 9, shortest: int = 4, most: int = 20_000) -> tuple[list[str], list[str]]:
    """(words, stems) that mark toxic texts, from (doc_id, text, toxic).

    Counted per text in Spark: whole words and their beginnings of ``shortest`` to ``longest`` letters. A word needs
    ``min_toxic`` toxic texts and ``precision`` (with one clean text added); a stem
    twice as many, three words and the share ``sure``.
    The lexicon keeps the ``most`` best, its documented size. Stems that begin with another stem are left out.
    """
    def spell(batches):
        for batch in batches:
            part, toxic, words = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            for text in part:
                words.append(set(WORD.findall((text or "").lower())))
            flat = [w for ws in words for w in ws]
            yield pa.RecordBatch.from_arrays([pa.array(flat, pa.string()), pa.array(np.repeat(np.array(toxic, np.int64), [len(w) for w in words]))], names=["word", "toxic"])

    counted = taught.select("text", F.col("toxic").cast("long")).mapInArrow(spell, "word string, toxic long").groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad"))

    plain = (F.col("bad") >= min_toxic) & (F.col("bad") >= precision * (F.col("n") + 1))
    stem = (F.col("bad") >= 2 * min_toxic) & (F.col("bad") >= sure * (F.col("n") + 1)) & (F.col("kinds") >= 3)
    starts = F.transform(F.sequence(F.lit(shortest), F.lit(longest)), lambda k: F.when(F.length("word") > k, F.substring("word", F.lit(1), k)))
    both = counted.select(F.explode(F.concat(F.array(F.struct(F.col("word").alias("x"), F.lit(False).alias("stem"))), F.transform(
        F.filter(starts, lambda s: s.isNotNull()), lambda s: F.struct(s.alias("x"), F.lit(True).alias("stem"))))).alias("k"), "n", "bad")
    found = both.groupBy("k").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("kinds"))
    kept = found.where(F.when(F.col("k.stem"), stem).otherwise(plain)).orderBy(F.desc(F.col("bad") / (F.col("n") + 1)), F.desc("bad"), "k").limit(most)
    rows = [(r["k"]["x"], r["k"]["stem"]) for r in kept.collect()]
    stems: list[str] = []
    for s in sorted(x for x, stem in rows if stem):
        if not stems or not s.startswith(stems[-1]):
            stems.append(s)
    return sorted(x for x, stem in rows if not stem), stems


def fit(taught: DataFrame) -> tuple[Grammar, dict[str, float], float]:
    """(grammar, chance of a toxic text per pattern, base rate) from (doc_id, text, toxic)."""
    words, stems = learn_insults(taught)
    grammar = Grammar(words, stems)

    def parse(batches):
        for batch in batches:
            keys = ["; ".join(sorted(grammar.patterns(t or ""))) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), batch.column(1)], names=["found", "toxic"])

    rows = taught.select("text", F.col("toxic").cast("long")).mapInArrow(parse, "found string, toxic long").groupBy("found").agg(
        F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("bad")).collect()
    weights = {}
    for pattern, prior in PATTERNS.items():
        own = [r for r in rows if pattern in r["found"].split("; ")]
        alone = [r for r in own if r["found"] == pattern] or own
        n, bad = sum(r["n"] for r in alone), sum(r["bad"] for r in alone)
        weights[pattern] = (bad + PRIOR * prior) / (n + PRIOR)
    clean = [r for r in rows if not r["found"]]
    return grammar, weights, (sum(r["bad"] for r in clean) + 0.5) / (sum(r["n"] for r in clean) + 10.0)


def score(docs: DataFrame, grammar: Grammar, weights: dict[str, float], base: float) -> DataFrame:
    """One row per document: doc_id, score, predicted, patterns (what its clauses matched, by name and count).

    A null or empty text matches nothing and gets the base rate; null ids and repeated rows are scored like
    others; other columns are ignored; no rows give no rows.
    """
    words, stems, reach = [w for w, k in grammar.cues.items() if k == "I"], list(grammar.stems), grammar.reach
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rate(batches):
        own = Grammar(words, stems, reach)
        for batch in batches:
            found = [own.patterns(t or "") for t in batch.column(1).to_pylist()]
            told = [", ".join(f"{k} x{n}" for k, n in sorted(f.items())) for f in found]
            scores = np.round([score_of(f, weights, base) for f in found], 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array((scores >= 0.5).astype(np.int32)), pa.array(told, pa.string())], names=["doc_id", "score", "predicted", "patterns"])

    return docs.select("doc_id", "text").mapInArrow(rate, f"doc_id {kind}, score double, predicted int, patterns string")
