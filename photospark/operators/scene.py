"""Scene scores, rankings and the rule table of adjustment limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from photospark.contract import LIGHTING, SUBJECTS
from photospark.functions.arrays import dot, norm

# Starting limits and, per rule, the caps it lowers them to (color, tone, shadow).
START = (0.35, 0.15, 0.75)
RULES = {
    "night_mood": (0.10, 0.0, 0.0),
    "sunset_silhouette": (0.15, 0.025, 0.15),
    "uncertain_lighting": (0.15, 0.03, 0.20),
    "very_dark_source": (0.10, 0.02, 0.10),
    "document_preserved": (0.0, 0.0, 0.0),
}


def label_vectors(prompts: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """(label, vector): unit-length mean of the unit-length prompt vectors of each label."""
    unit = F.transform(vector, lambda v: v.cast("double") / norm(F.col(vector)))
    cells = prompts.select(label, F.posexplode(unit).alias("pos", "v")).groupBy(label, "pos").agg(F.avg("v").alias("v"))
    # one cell per vector position, so the collected group is bounded by the vector width
    packed = cells.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda e: e["v"]).alias("m"))
    return packed.select(label, F.transform("m", lambda v: v / norm(F.col("m"))).alias("vector"))


def score_labels(emb: DataFrame, labels: DataFrame, key: str = "photo", limit: int = 1000) -> DataFrame:
    """Cosine of every embedding with every label vector.

    The label set is small by contract (more than ``limit`` rows fail the job), so it travels as one scalar
    row and each embedding is scored where it is read.
    """
    entry = F.struct("family", "label", "vector", norm(F.col("vector")).alias("length"))
    packed = labels.agg(F.count(F.lit(1)).alias("n"), F.collect_list(entry).alias("t"))
    bounded = packed.where(F.when(F.col("n") > limit, F.raise_error(F.lit("label vectors exceed their bound")).cast("boolean")).otherwise(F.lit(True)))
    table = bounded.select("t").scalar()
    ready = emb.select(key, "view", F.col("embedding").alias("_e"), norm(F.col("embedding")).alias("_n"), table.alias("_t"))

    def score(row: Column) -> Column:
        scale = F.col("_n") * row["length"]
        return F.struct(row["family"].alias("family"), row["label"].alias("label"), F.when(scale > 0, dot(F.col("_e"), row["vector"]) / scale).otherwise(F.lit(0.0)).alias("score"))

    return ready.select(key, "view", F.explode(F.transform("_t", score)).alias("_s")).select(key, "view", "_s.*")


def _label_order(scores: DataFrame) -> Column:
    """Vocabulary order for named labels, plain order otherwise."""
    if scores.schema["label"].dataType.simpleString() != "string":
        return F.col("label")
    place = F.array_position(F.array(*[F.lit(n) for n in (*SUBJECTS, *LIGHTING)]), F.col("label"))
    return F.when(place > 0, place).otherwise(F.raise_error(F.concat(F.lit("label outside the vocabulary: "), F.col("label"))).cast("int"))


def top_two(scores: DataFrame, key: str = "photo") -> DataFrame:
    """Top label, runner-up and gap per (photo, view, family); ties go to the earlier label."""
    w = Window.partitionBy(key, "view", "family").orderBy(F.desc("score"), _label_order(scores))
    ranked = scores.withColumn("_r", F.row_number().over(w)).withColumn("second", F.lead("label").over(w)).withColumn("_s2", F.lead("score").over(w))
    return ranked.where("_r = 1").select(key, "view", "family", F.col("label").alias("top"), "score", "second", (F.col("score") - F.col("_s2")).alias("gap"))


def near_top(scores: DataFrame, tolerance: float, key: str = "photo") -> DataFrame:
    """Per (photo, family, label): within ``tolerance`` of the top in any view and in every view."""
    best = F.max("score").over(Window.partitionBy(key, "view", "family"))
    near = F.col("score") >= best - tolerance
    return scores.withColumn("_n", near).groupBy(key, "family", "label").agg(F.bool_or("_n").alias("any_view"), F.bool_and("_n").alias("every_view"))


def view_flags(scores: DataFrame, night, sunset, underexposed, document, key: str = "photo") -> DataFrame:
    """One row per photo with the flags the rules need; label arguments name the special labels."""
    top = top_two(scores, key)
    light, subject = F.col("family") == "lighting", F.col("family") == "subject"
    flags = top.groupBy(key).agg(
        F.bool_and(F.when(light, F.col("top") == night)).alias("night_both"),
        F.bool_or(F.when(light, F.col("top") == underexposed)).alias("under_any"),
        (F.min(F.when(light, F.col("top"))) != F.max(F.when(light, F.col("top")))).alias("disagree"),
        F.min(F.when(light, F.col("gap"))).alias("light_gap"),
        F.bool_and(F.when(subject, (F.col("top") == document) & (F.col("gap") >= 0.02))).alias("document_both"))
    near = near_top(scores.where("family = 'lighting'"), 0.02, key).where(F.col("label") == sunset).select(key, F.col("any_view").alias("near_sunset"))
    return flags.join(near, key, "left").withColumn("near_sunset", F.coalesce("near_sunset", F.lit(False)))


def scene_limits(flags: DataFrame, lumas: DataFrame, key: str = "photo") -> DataFrame:
    """Adjustment caps and reasons: each rule that holds lowers all three caps to its own.

    ``lumas``: (photo, luma_median). A photo without flags keeps the starting limits with a fallback reason.
    """
    j = lumas.select(key, "luma_median").join(flags.withColumn("_seen", F.lit(True)), key, "left")
    on: dict[str, Column] = {
        "night_mood": F.col("night_both") & (F.col("luma_median") < 0.25),
        "sunset_silhouette": F.col("near_sunset"),
        "uncertain_lighting": F.col("disagree") | F.col("under_any") | (F.col("light_gap") < 0.015),
        "very_dark_source": F.col("luma_median") < 0.06,
        "document_preserved": F.col("document_both"),
    }
    active = {name: F.col("_seen") & F.coalesce(cond, F.lit(False)) for name, cond in on.items()}
    names = ("color_strength", "tone_lift", "shadow_strength")
    caps = [F.least(F.lit(START[i]), *[F.when(active[r], RULES[r][i]) for r in RULES]).alias(n) for i, n in enumerate(names)]
    reasons = F.when(F.col("_seen").isNull(), F.array(F.lit("recognition_unavailable"))).otherwise(
        F.array_compact(F.array(*[F.when(active[r], F.lit(r)) for r in RULES])))
    return j.select(key, *caps, reasons.alias("reasons"), F.when(F.col("_seen").isNull(), "recognition_fallback")
                    .when(F.size(reasons) == 0, "existing_limits").otherwise("restricted").alias("status"))


def score_agreement(a: DataFrame, b: DataFrame, key: str = "photo") -> DataFrame:
    """Per (photo, view): whether all family rankings agree in their top label and the largest score difference."""
    diff = a.join(b.select(key, "view", "family", "label", F.col("score").alias("_b")), [key, "view", "family", "label"]).groupBy(key, "view").agg(
        F.max(F.abs(F.col("score") - F.col("_b"))).alias("max_difference"))
    tops = top_two(a, key).select(key, "view", "family", "top").join(top_two(b, key).select(key, "view", "family", F.col("top").alias("_o")), [key, "view", "family"])
    return tops.groupBy(key, "view").agg(F.bool_and(F.col("top") == F.col("_o")).alias("rankings_match")).join(diff, [key, "view"])
