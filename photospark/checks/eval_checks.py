"""Baselines, metrics, strata, gates, comparisons and rankings against their SQL twins."""

import math

from pyspark.sql import functions as F

from photospark.checks.label_checks import CONTRACT, TARGETS, targets
from photospark.checks.registry import check
from photospark.contract import bound
from photospark.functions import arrays as AR
from photospark.functions import color as K
from photospark.operators import baselines as B
from photospark.operators import gates as G
from photospark.operators import labels as L
from photospark.operators import metrics as M
from photospark.operators import quantiles as Q
from photospark.operators import splits as S
from photospark.session import cut_lineage

LONG = "labels_long split_of features4"
DELIVERED = ("Exposure", "HighlightRecovery")
TRUTH = TARGETS.strip() + f""",
    truth AS MATERIALIZED (SELECT t.photo, s.split, t.parameter, 2 * (mean - lo) / (hi - lo) - 1 AS truth, mean, std FROM targets t JOIN {CONTRACT} USING (parameter) JOIN split_of s USING (photo))"""
PREDS = TRUTH + """,
    preds AS MATERIALIZED (SELECT 'constant' AS model, photo, split, parameter, c AS pred, truth FROM truth JOIN (SELECT parameter, avg(truth) AS c FROM truth WHERE split = 'train' GROUP BY parameter) b USING (parameter) WHERE split <> 'train'
      UNION ALL SELECT 'linear', photo, split, parameter, least(greatest(a + b * x0, -1), 1), truth FROM truth JOIN features4 USING (photo)
        JOIN (SELECT parameter, regr_slope(truth, x0) AS b, regr_intercept(truth, x0) AS a FROM truth JOIN features4 USING (photo) WHERE split = 'train' GROUP BY parameter) f USING (parameter) WHERE split <> 'train')"""
ERRORS = PREDS + f""",
    errors AS (SELECT *, raw_pred - raw_truth AS raw_error FROM (SELECT preds.*, abs(pred - truth) AS abs_norm, (least(greatest(pred, -1), 1) + 1) / 2 * (hi - lo) + lo AS raw_pred,
        (truth + 1) / 2 * (hi - lo) + lo AS raw_truth FROM preds JOIN {CONTRACT} USING (parameter)) q)"""
SCORES = ERRORS + """,
    pscore AS (SELECT model, split, photo, exposure_error, recovery_error, (abs(exposure_error) / 8 + abs(recovery_error) / 100) / 2 AS p2 FROM (
      SELECT model, split, photo, max(CASE WHEN parameter = 'Exposure' THEN raw_error END) AS exposure_error, max(CASE WHEN parameter = 'HighlightRecovery' THEN raw_error END) AS recovery_error
      FROM errors GROUP BY model, split, photo) q)"""
SUMMARY = "avg(abs_norm) AS macro_normalized_mae, (avg(abs_norm) FILTER (WHERE parameter = 'Exposure') + avg(abs_norm) FILTER (WHERE parameter = 'HighlightRecovery')) / 4 AS p2"


def truth(v):
    p = "parameter"
    t = targets(v).join(v.split_of.select("photo", "split"), "photo")
    return t.withColumn("truth", (F.col("mean") - bound(p, "lo")) * 2 / (bound(p, "hi") - bound(p, "lo")) - 1)


def preds(v):
    # both baselines fit on train and predict the rest: targets and feature are made once and written, not once per use
    x0 = v.features4.select("photo", "x0", F.lit(True).alias("has"))
    t = cut_lineage(truth(v).select("photo", "split", "parameter", "truth").join(x0, "photo", "left"))
    return B.constant_baseline(t).unionByName(B.simple_linear_baseline(t.where("has"), "x0"))


def errors(v):
    return M.with_errors(preds(v))


def pscores(v):
    # a photo has all parameters or none
    return M.two_field_score(errors(v).where(F.col("parameter").isin(*DELIVERED)), ["model", "split", "photo"])


@check("b1_constant_baseline", "WITH " + PREDS + " SELECT photo, parameter, pred FROM preds WHERE model = 'constant'", views=LONG, doubles="pred")
def _(v):
    return B.constant_baseline(truth(v)).select("photo", "parameter", "pred")


@check("b2_linear_one_feature", "WITH " + PREDS + " SELECT photo, parameter, pred FROM preds WHERE model = 'linear'", views=LONG, doubles="pred")
def _(v):
    return B.simple_linear_baseline(truth(v).join(v.features4, "photo"), "x0").select("photo", "parameter", "pred")


def wide_truth(v):
    t = truth(v)
    wide = t.groupBy("photo", "split").agg(*[F.max(F.when(F.col("parameter") == n, F.col("truth"))).alias(n) for n in ("Exposure", "HighlightRecovery")])
    joined = wide.join(v.features4, "photo")
    cols = ["x0", "x1", "x2", "x3"]
    return M.standardize(joined, cols, M.fit_standardizer(joined.where("split = 'train'"), cols)), cols


def fit_sql(name, source, target, weight="1", reg="0"):
    """CTEs that eliminate the 4 x 4 normal equations of a target on x0..x3 column by column; the last one, ``name``, has one row of coefficients."""
    w = f"CAST({weight} AS DOUBLE)"
    mean = lambda v: f"(sum({w} * ({v})) / sum({w}))"
    firsts = ", ".join(f"{mean(c)} AS c{i}" for i, c in enumerate(("x0", "x1", "x2", "x3", target)))
    off = lambda i: f"({target} - c4)" if i == 4 else f"(x{i} - c{i})"
    keys = "reg, c0, c1, c2, c3, c4"
    cells = ", ".join(f"{mean(off(i) + ' * ' + off(j))}" + (f" * (1 + reg)" if i == j else "") + f" AS m{i}{j}" for i in range(4) for j in range(5))
    steps = [f"{name}_c AS (SELECT {firsts} FROM {source})",
             f"{name}_0 AS (SELECT {keys}, {cells} FROM {source} CROSS JOIN {name}_c CROSS JOIN (SELECT unnest([{reg}])::DOUBLE AS reg) g GROUP BY {keys})"]
    for k in range(4):
        reduced = ", ".join((f"m{i}{j} / m{k}{k}" if i == k else f"m{i}{j} - m{i}{k} * m{k}{j} / m{k}{k}") + f" AS m{i}{j}" for i in range(4) for j in range(5))
        steps.append(f"{name}_{k + 1} AS (SELECT {keys}, {reduced} FROM {name}_{k})")
    steps.append(f"{name} AS (SELECT reg, m04 AS b0, m14 AS b1, m24 AS b2, m34 AS b3, c4 - m04 * c0 - m14 * c1 - m24 * c2 - m34 * c3 AS b4 FROM {name}_4)")
    return ", ".join(steps)


CLIPPED = "least(greatest(b0 * x0 + b1 * x1 + b2 * x2 + b3 * x3 + b4, -1), 1)"
WIDE = TRUTH + """, wide AS MATERIALIZED (SELECT t.photo, t.split, x0, x1, x2, x3, max(CASE WHEN parameter = 'Exposure' THEN truth END) AS Exposure, max(CASE WHEN parameter = 'HighlightRecovery' THEN truth END) AS HighlightRecovery
      FROM truth t JOIN features4 USING (photo) GROUP BY ALL), learn AS MATERIALIZED (SELECT * FROM wide WHERE split = 'train')"""


@check("b2_linear_baseline", f"""WITH {WIDE}, {fit_sql('fe', 'learn', 'Exposure')}, {fit_sql('fh', 'learn', 'HighlightRecovery')}
    SELECT 'physical_linear' AS model, photo, split, 'Exposure' AS parameter, {CLIPPED} AS pred, Exposure AS truth FROM wide CROSS JOIN fe WHERE split <> 'train'
    UNION ALL SELECT 'physical_linear', photo, split, 'HighlightRecovery', {CLIPPED}, HighlightRecovery FROM wide CROSS JOIN fh WHERE split <> 'train'""", views=LONG, doubles="pred truth")
def _(v):
    wide, cols = wide_truth(v)
    return B.linear_baseline(wide, cols, ("Exposure", "HighlightRecovery"))


def picks_sql(seed):
    """The Poisson(1) numbers of ``linear.poisson_picks``."""
    shares, term = [], math.exp(-1)
    for k in range(1, 13):
        shares.append((shares[-1] if shares else 0) + term)
        term /= k
    return "(" + " + ".join(f"CASE WHEN @pick(k{seed}) >= {int(s * 2 ** 32)} THEN 1 ELSE 0 END" for s in shares) + ")"


SEEDS = (7, 17, 42)
PICKED = "picked AS MATERIALIZED (SELECT *, " + ", ".join(f"{picks_sql(s)} AS w{s}" for s in SEEDS) + " FROM (SELECT *, " + ", ".join(f"concat('{s}-', CAST(photo AS VARCHAR)) AS k{s}" for s in SEEDS) + " FROM learn) q)"
GRID = "0.0, 0.1, 1.0"


@check("b4_grid_screen", f"""WITH {WIDE}, {PICKED}, {fit_sql('fg', 'learn', 'Exposure', reg=GRID)}, {", ".join(fit_sql(f"fs{s}", "picked", "Exposure", f"w{s}", GRID) for s in SEEDS)},
    screen AS (SELECT 'screen' AS stage, reg, CAST(NULL AS INT) AS seed, avg(abs({CLIPPED} - Exposure)) AS score FROM wide CROSS JOIN fg WHERE split = 'val' GROUP BY reg),
    best AS (SELECT reg FROM screen ORDER BY score, reg LIMIT 1)
    SELECT * FROM screen {" ".join(f"UNION ALL SELECT 'rerun', reg, {s}, avg(abs({CLIPPED} - Exposure)) FROM wide CROSS JOIN (SELECT * FROM fs{s} JOIN best USING (reg)) q WHERE split = 'val' GROUP BY reg" for s in SEEDS)}""", views=LONG, doubles="reg score")
def _(v):
    wide, cols = wide_truth(v)
    return B.grid_screen(wide, cols, ("Exposure",), [0.0, 0.1, 1.0], SEEDS)


@check("b3_batch_score", """SELECT vec_id, CAST(i AS INTEGER) AS pos, least(greatest(CAST((@elem(embedding, i) + @elem(embedding, i + 6)) AS DOUBLE), -1), 1) AS v
    FROM embeddings, (SELECT unnest(range(6)) AS i) n""", doubles="v")
def _(v):
    def make():
        def predict(x):
            return x[:, :6] + x[:, 6:12]
        return predict
    feat = v.embeddings.select("vec_id", F.col("embedding").alias("x"))
    return B.batch_score(feat, make).select("vec_id", F.posexplode("prediction").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


@check("b5_delta", """
    SELECT l_orderkey AS photo, 'v' || l_linenumber AS version, l_returnflag AS parameter, value - current AS delta FROM
      (SELECT l_orderkey, l_linenumber, l_returnflag, sum(l_quantity) AS value FROM lineitem WHERE l_linestatus = 'F' GROUP BY ALL) a
      JOIN (SELECT l_orderkey, l_linenumber, l_returnflag, sum(l_quantity) AS current FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL) b USING (l_orderkey, l_linenumber, l_returnflag)""", doubles="delta")
def _(v):
    def values(status):
        return v.lineitem.where(F.col("l_linestatus") == status).groupBy(F.col("l_orderkey").alias("photo"), F.concat(F.lit("v"), F.col("l_linenumber").cast("string")).alias("version"),
                                                                        F.col("l_returnflag").alias("parameter")).agg(F.sum("l_quantity").alias("value"))
    return B.delta(values("F"), values("O")).select("photo", "version", "parameter", "delta")


# ------------------------------------------------------------------ standardiser and thresholds

@check("a17_standardizer", """
    SELECT photo, (x0 - m0) / s0 AS x0, (x3 - m3) / s3 AS x3 FROM features4, (SELECT avg(x0) AS m0, stddev_pop(x0) AS s0, avg(x3) AS m3, stddev_pop(x3) AS s3
      FROM features4 JOIN split_of USING (photo) WHERE split = 'train') t""", views="features4 split_of", doubles="x0 x3", digits=5)
def _(v):
    train = S.with_split(v.features4, v.split_of, "photo").where("split = 'train'")
    return M.standardize(v.features4, ["x0", "x3"], M.fit_standardizer(train, ["x0", "x3"])).select("photo", "x0", "x3")


@check("a18_thresholds", """
    SELECT quantile_cont(x3, 1.0/3) AS lower, quantile_cont(x3, 2.0/3) AS upper FROM features4 JOIN split_of USING (photo) WHERE split = 'train'""", views="features4 split_of", doubles="lower upper", digits=4)
def _(v):
    train = S.with_split(v.features4, v.split_of, "photo").where("split = 'train'")
    return M.fit_thresholds(train, "x3", {"lower": 1 / 3, "upper": 2 / 3})


@check("a18_tails", "WITH " + TRUTH + " SELECT parameter, quantile_cont(mean, 0.01) AS p1, quantile_cont(mean, 0.99) AS p99 FROM truth WHERE split = 'train' GROUP BY parameter", views=LONG, doubles="p1 p99")
def _(v):
    return M.fit_tails(truth(v).where("split = 'train'"))


BANDS = """thr AS (SELECT quantile_cont(x3, 1.0/3) AS lower, quantile_cont(x3, 2.0/3) AS upper FROM features4 JOIN split_of USING (photo) WHERE split = 'train'),
    bands AS (SELECT photo, CASE WHEN x3 <= lower THEN 'dark' WHEN x3 > upper THEN 'bright' ELSE 'middle' END AS band FROM features4, thr)"""


def bands(v):
    train = S.with_split(v.features4, v.split_of, "photo").where("split = 'train'")
    return M.brightness_band(v.features4, M.fit_thresholds(train, "x3", {"lower": 1 / 3, "upper": 2 / 3}), "x3")


@check("w8_brightness_band", "WITH " + BANDS + " SELECT photo, band FROM bands", views="features4 split_of")
def _(v):
    return bands(v).select("photo", "band")


# ------------------------------------------------------------------ metrics

@check("a19_regression_metrics", "WITH " + ERRORS + """
    SELECT model, split, parameter, count(*) AS n, avg(abs_norm) AS normalized_mae, avg(abs(raw_error)) AS mae, sqrt(avg(raw_error * raw_error)) AS rmse,
      coalesce(avg(CASE WHEN parameter = 'Temperature' THEN abs(1e6 / raw_pred - 1e6 / raw_truth) END), -1) AS mired_mae FROM errors GROUP BY model, split, parameter""",
       views=LONG, doubles="normalized_mae mae rmse mired_mae")
def _(v):
    return M.regression_metrics(errors(v), ["model", "split"]).fillna(-1.0, ["mired_mae"])


@check("a19_summary_metrics", "WITH " + ERRORS + f" SELECT model, split, CAST(count(*) / 6 AS BIGINT) AS photos, {SUMMARY} FROM errors GROUP BY model, split", views=LONG, doubles="macro_normalized_mae p2")
def _(v):
    return M.summary_metrics(errors(v), ["model", "split"])


BUCKETS = BANDS + """,
    tail AS (SELECT parameter, quantile_cont(mean, 0.01) AS p1, quantile_cont(mean, 0.99) AS p99 FROM truth WHERE split = 'train' GROUP BY parameter),
    buckets AS (SELECT photo, 'brightness/' || band AS bucket FROM bands
      UNION ALL SELECT photo, 'camera/' || coalesce(camera, 'unknown') FROM bands LEFT JOIN photos USING (photo)
      UNION ALL SELECT photo, 'catalog_tag/' || coalesce(tag, 'untagged') FROM bands LEFT JOIN tags USING (photo)
      UNION ALL SELECT photo, 'tail/' || parameter FROM truth JOIN tail USING (parameter) WHERE mean < p1 OR mean > p99)"""


def buckets(v):
    t = truth(v)
    tails = M.tail_buckets(t, M.fit_tails(t.where("split = 'train'")))
    cameras = v.photos.where("camera <> '3-MEDIUM'")
    return M.photo_buckets(bands(v), cameras, v.tags, tails)


@check("a20_stratified_metrics", "WITH " + ERRORS + ", " + BUCKETS.replace("LEFT JOIN photos USING (photo)", "LEFT JOIN (SELECT * FROM photos WHERE camera <> '3-MEDIUM') c USING (photo)") + f"""
    SELECT bucket, model, CAST(count(*) / 6 AS BIGINT) AS photos, {SUMMARY}, count(*) / 6 < 10 AS small FROM errors JOIN buckets USING (photo) GROUP BY bucket, model""",
       views=LONG + " photos tags", doubles="macro_normalized_mae p2")
def _(v):
    return M.stratified_metrics(errors(v), buckets(v))


@check("a44_small_group_flag", "SELECT camera, status, count(*) AS photos, count(*) < 1000 AS small FROM photos GROUP BY camera, status", views="photos")
def _(v):
    return M.small_group_flag(v.photos.groupBy("camera", "status").agg(F.count(F.lit(1)).alias("photos")), 1000)


@check("a21_failure_strata", "WITH " + SCORES + ", " + BANDS + """
    SELECT band, model, count(*) AS n, avg(p2) AS p2, avg(abs(exposure_error)) AS exposure_mae, avg(abs(recovery_error)) AS recovery_mae, avg(exposure_error) AS exposure_bias
    FROM pscore JOIN bands USING (photo) GROUP BY band, model""", views=LONG, doubles="p2 exposure_mae recovery_mae exposure_bias")
def _(v):
    return M.failure_strata(pscores(v), bands(v))


@check("a22_error_correlation", "WITH " + SCORES + " SELECT model, corr(abs(exposure_error), std) AS correlation FROM pscore JOIN truth ON truth.photo = pscore.photo AND parameter = 'Exposure' GROUP BY model", views=LONG, doubles="correlation")
def _(v):
    spread = truth(v).where("parameter = 'Exposure'").select("photo", "std")
    return M.error_correlation(pscores(v).join(spread, "photo"), "exposure_error", "std", ["model"])


@check("a23_worst_share", "WITH " + SCORES + " SELECT (SELECT sum(p2) FROM (SELECT p2 FROM pscore WHERE model = 'linear' ORDER BY p2 DESC, photo LIMIT 20) w) / sum(p2) AS share FROM pscore WHERE model = 'linear'", views=LONG, doubles="share")
def _(v):
    return M.worst_share(pscores(v).where("model = 'linear'"), "p2", 20)


@check("k2_worst_k", "WITH " + SCORES + " SELECT photo, p2 FROM pscore WHERE model = 'linear' ORDER BY p2 DESC, photo LIMIT 20", views=LONG, doubles="p2")
def _(v):
    return M.worst_k(pscores(v).where("model = 'linear'"), "p2", 20).select("photo", "p2")


@check("w4_rank_errors", "SELECT doc_id AS photo, n_chars AS score, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents")
def _(v):
    return M.rank_errors(v.documents.select(F.col("doc_id").alias("photo"), F.col("n_chars").alias("score")), "score")


@check("w9_order_picks", """
    SELECT 'first' AS pick, min(photo) AS photo, arg_min(price, photo) AS price FROM photos UNION ALL
    SELECT CASE WHEN r - 1 = round_even((n - 1) * 0.05, 0) THEN 'low' ELSE 'high' END, photo, price FROM (SELECT photo, price, row_number() OVER (ORDER BY price, photo) AS r, count(*) OVER () AS n FROM photos) q
    WHERE r - 1 IN (round_even((n - 1) * 0.05, 0), round_even((n - 1) * 0.95, 0))""", views="photos", doubles="price")
def _(v):
    return M.order_picks(v.photos, "price").select("pick", "photo", "price")


@check("a24_win_fraction", "WITH " + SCORES + " SELECT avg(CASE WHEN l.p2 < c.p2 THEN 1.0 ELSE 0.0 END) AS beats_constant FROM pscore l JOIN pscore c ON c.photo = l.photo AND c.model = 'constant' WHERE l.model = 'linear'", views=LONG, doubles="beats_constant")
def _(v):
    return M.win_fraction(pscores(v), "linear", ["constant"])


@check("a27_mean_metrics", "SELECT label, avg(CASE WHEN v > 0 THEN v END) AS v FROM label_means GROUP BY label", views="label_means", doubles="v")
def _(v):
    return M.mean_metrics(v.label_means.select("label", F.when(F.col("v") > 0, F.col("v")).alias("v")), ["v"], ["label"])


@check("a29_effect_summary", """SELECT count(*) AS photos, count(*) FILTER (WHERE x1 * 20 < x2 * 25) AS higher, count(*) FILTER (WHERE x1 * 20 > x2 * 25) AS lower, count(*) FILTER (WHERE x1 * 20 = x2 * 25) AS equal,
    min(x2 * 25 - x1 * 20) AS min_change, max(x2 * 25 - x1 * 20) AS max_change, avg(x1 * 20) AS mean_before, avg(x2 * 25) AS mean_after
    FROM (SELECT round(x1, 3) AS x1, round(x2, 3) AS x2 FROM features4) q""", views="features4", doubles="min_change max_change mean_before mean_after")
def _(v):
    return M.effect_summary(v.features4.select((F.round("x1", 3) * 20).alias("before"), (F.round("x2", 3) * 25).alias("after")))


@check("a30_reason_counts", "SELECT reason, count(event_id) AS n FROM (VALUES ('click'), ('error'), ('purchase'), ('never')) r(reason) LEFT JOIN events ON event_type = reason GROUP BY reason")
def _(v):
    return M.reason_counts(v.events.select(F.array("event_type").alias("reasons")), ["click", "error", "purchase", "never"])


@check("a32_crosstab", "SELECT coalesce(split, '*') AS split, coalesce(status, '*') AS status, count(*) AS n, CAST(grouping_id(split, status) AS BIGINT) AS level FROM split_of JOIN photos USING (photo) GROUP BY ROLLUP (split, status)", views="split_of photos")
def _(v):
    return M.crosstab(v.split_of.join(v.photos.select("photo", "status"), "photo"), "split", "status").fillna("*", ["split", "status"])


@check("a41_latency_summary", "SELECT event_type AS config, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95 FROM events GROUP BY event_type", doubles="p50 p95")
def _(v):
    return M.latency_summary(v.events.select(F.col("event_type").alias("config"), "value"), "config", "value")


@check("a45_repeat_difference", "SELECT max(d) AS max_difference, min(n) AS min_runs, max(n) AS max_runs FROM (SELECT max(score) - min(score) AS d, count(*) AS n FROM scores GROUP BY photo, label) q", views="scores", doubles="max_difference")
def _(v):
    return M.repeat_difference(v.scores, ["photo", "label"], "view", "score")


@check("p15_label_match", """SELECT doc_id AS photo, quality AS label, quality = ANY(CASE WHEN toxic = 1 THEN [0] ELSE [0, 1] END) AS match FROM labels""")
def _(v):
    pred = v.labels.select(F.col("doc_id").alias("photo"), F.col("quality").alias("label"))
    accepted = F.when(F.col("toxic") == 1, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))
    return M.label_match(pred, v.labels.select(F.col("doc_id").alias("photo"), accepted.alias("accepted"))).select("photo", "label", "match")


# ------------------------------------------------------------------ joins used by the evaluation

@check("j12_matched_coverage", """SELECT count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS matched, count(*) AS total,
    CAST(count(*) FILTER (WHERE doc_id IN (SELECT doc_id FROM labels)) AS DOUBLE) / count(*) AS coverage FROM documents""", doubles="coverage")
def _(v):
    return M.coverage(v.documents.select(F.col("doc_id").alias("photo")), v.labels.select(F.col("doc_id").alias("photo")))


@check("j13_pair_branches", "SELECT photo, avg(r) AS low, avg(g) AS high FROM pixels GROUP BY photo", views="pixels", doubles="low high")
def _(v):
    side = lambda c, n: v.pixels.groupBy("photo").agg(F.avg(c).alias(n))
    return M.pair_branches(side("r", "low"), side("g", "high"), "photo")


@check("j15_compare_versions", """
    WITH a AS (SELECT l_orderkey AS photo, min(l_returnflag) AS flag, max(l_linenumber) AS lines, avg(l_discount) AS e FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1),
         b AS (SELECT l_orderkey AS photo, min(l_returnflag) AS flag, max(l_linenumber) AS lines, avg(l_discount) AS e FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1)
    SELECT count(*) AS shared, count(*) FILTER (WHERE a.flag = b.flag) AS same_inputs, count(*) FILTER (WHERE a.lines <> b.lines) AS changed,
      count(*) FILTER (WHERE round(b.e, 6) < round(a.e, 6)) AS lower, count(*) FILTER (WHERE round(b.e, 6) > round(a.e, 6)) AS higher, count(*) FILTER (WHERE round(b.e, 6) = round(a.e, 6)) AS equal FROM a JOIN b USING (photo)""")
def _(v):
    def side(status):
        return v.lineitem.where(F.col("l_linestatus") == status).groupBy(F.col("l_orderkey").alias("photo")).agg(
            F.min("l_returnflag").alias("flag"), F.max("l_linenumber").alias("lines"), F.round(F.avg("l_discount"), 6).alias("e"))
    return M.compare_versions(side("F"), side("O"), "photo", ["flag"], ["lines"], "e")


GRID = [(e / 2 - 2.5, r) for e in range(11) for r in (0, 50, 100)]


@check("j16_expand_grid", "SELECT vec_id AS photo, CAST(e * 3 + r AS INTEGER) AS variant, e / 2 - 2.5 AS exposure, CAST(r * 50 AS DOUBLE) AS recovery FROM embeddings, range(11) x(e), range(3) y(r)", doubles="exposure recovery")
def _(v):
    return M.expand_grid(v.embeddings.select(F.col("vec_id").alias("photo")), GRID)


@check("j17_align", "WITH " + PREDS + " SELECT photo, parameter, pred, truth FROM preds WHERE model = 'linear'", views=LONG, doubles="pred truth")
def _(v):
    p = B.simple_linear_baseline(truth(v).join(v.features4, "photo"), "x0").select("photo", "parameter", "pred")
    return M.align(p, truth(v).where("split <> 'train'").select("photo", "parameter", "truth"), ["photo", "parameter"])


@check("j21_with_split", "SELECT photo_id, camera, split FROM photos JOIN split_of USING (photo_id)", views="photos split_of")
def _(v):
    return S.with_split(v.photos.select("photo_id", "camera"), v.split_of)


@check("j22_same_rows", """SELECT (SELECT count(*) FROM (SELECT photo, tag FROM tags EXCEPT SELECT l_orderkey, l_returnflag FROM lineitem WHERE l_linestatus = 'O') a) AS only_first,
    (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem WHERE l_linestatus = 'O' EXCEPT SELECT photo, tag FROM tags) b) AS only_second""", views="tags")
def _(v):
    other = v.lineitem.where("l_linestatus = 'O'").select(F.col("l_orderkey").alias("photo"), F.col("l_returnflag").alias("tag")).distinct()
    out = M.same_rows(v.tags, other, ["photo", "tag"])
    return out.select(F.col("only_first").cast("long").alias("only_first"), F.col("only_second").cast("long").alias("only_second"))


@check("w5_best_variant", """
    SELECT photo, variant, mse FROM (SELECT photo, variant, mse, row_number() OVER (PARTITION BY photo ORDER BY mse, variant) AS rn FROM (
      SELECT l_orderkey AS photo, l_linenumber AS variant, min(l_discount) AS mse FROM lineitem GROUP BY 1, 2) s) q WHERE rn = 1""", doubles="mse")
def _(v):
    s = v.lineitem.groupBy(F.col("l_orderkey").alias("photo"), F.col("l_linenumber").alias("variant")).agg(F.min("l_discount").alias("mse"))
    return M.best_variant(s, ["photo"], "mse")


@check("w6_best_epoch", """
    WITH RECURSIVE walk AS (SELECT run, epoch AS epoch, val AS best, epoch AS best_epoch, 0 AS stale FROM history WHERE epoch = 1
      UNION ALL SELECT h.run, h.epoch, CASE WHEN h.val < w.best THEN h.val ELSE w.best END, CASE WHEN h.val < w.best THEN h.epoch ELSE w.best_epoch END, CASE WHEN h.val < w.best THEN 0 ELSE w.stale + 1 END
      FROM walk w JOIN history h ON h.run = w.run AND h.epoch = w.epoch + 1 WHERE w.stale < 5)
    SELECT run, max(best_epoch) AS best_epoch, min(best) AS best_val, max(epoch) AS epochs_run FROM walk GROUP BY run""", views="history", doubles="best_val")
def _(v):
    return M.best_epoch(v.history.withColumn("epoch", F.col("epoch").cast("long")), 5)


# ------------------------------------------------------------------ bootstrap and gates

GROUP_ERRORS = SCORES + """,
    perr AS (SELECT s.group_id, c.p2 AS control, l.p2 AS candidate FROM pscore c JOIN pscore l ON l.photo = c.photo AND l.model = 'linear' JOIN split_of s ON s.photo = c.photo WHERE c.model = 'constant'),
    sums AS (SELECT group_id, sum(control) AS control, sum(candidate) AS candidate, row_number() OVER (ORDER BY group_id) - 1 AS pos FROM perr GROUP BY group_id)"""
DRAWS, BUCKET = 400, 64
BOOT = GROUP_ERRORS + f""",
    dealt AS (SELECT draw, bucket, count(*) AS k, any_value(g) AS g FROM (
      SELECT id // g AS draw, (@pick('7-' || id) % g) // {BUCKET} AS bucket, g FROM (SELECT count(*) AS g FROM sums) n, LATERAL (SELECT unnest(range(0, {DRAWS} * g)) AS id) r) q GROUP BY 1, 2),
    picks AS (SELECT draw, bucket * {BUCKET} + @pick('7-' || draw || '-' || bucket || '-' || j) % least({BUCKET}, g - bucket * {BUCKET}) AS pos FROM (
      SELECT draw, bucket, g, unnest(range(1, k + 1)) AS j FROM dealt) q),
    draws AS (SELECT draw, 1 - sum(candidate) / sum(control) AS gain FROM picks JOIN sums USING (pos) GROUP BY draw)"""


def group_errors(v, s):
    wide = s.groupBy("photo").agg(F.max(F.when(F.col("model") == "constant", F.col("p2"))).alias("control"), F.max(F.when(F.col("model") == "linear", F.col("p2"))).alias("candidate"))
    return wide.join(v.split_of.select("photo", "group_id"), "photo")


@check("a33_paired_bootstrap", "WITH " + BOOT + " SELECT quantile_cont(gain, 0.025) AS low, quantile_cont(gain, 0.975) AS high FROM draws", views=LONG, doubles="low high")
def _(v):
    return G.paired_bootstrap(group_errors(v, pscores(v)), DRAWS, 7, width=BUCKET)


@check("a34_seed_summary", "SELECT event_type AS run, avg(value) AS mean, stddev_samp(value) AS sd, count(*) AS seeds FROM events GROUP BY event_type", doubles="mean sd")
def _(v):
    return G.seed_summary(v.events.select(F.col("event_type").alias("run"), "value"), "run", "value")


@check("k3_pick_winner", "SELECT run, mean FROM (SELECT user_id AS run, avg(value) AS mean FROM events GROUP BY 1) q ORDER BY mean, run LIMIT 1", doubles="mean")
def _(v):
    return G.pick_winner(v.events.groupBy(F.col("user_id").alias("run")).agg(F.avg("value").alias("mean")), "run", "mean")


@check("a35_promotion_gates", "WITH " + BOOT + """,
    runs AS (SELECT split AS seed, avg(p2) FILTER (WHERE model = 'constant') AS control, avg(p2) FILTER (WHERE model = 'linear') AS candidate FROM pscore GROUP BY split),
    fields AS (SELECT parameter, avg(abs(raw_error)) FILTER (WHERE model = 'constant') AS control, avg(abs(raw_error)) FILTER (WHERE model = 'linear') AS candidate FROM errors WHERE parameter IN ('Exposure', 'HighlightRecovery') GROUP BY parameter),
    g AS (SELECT (SELECT count(*) FROM runs WHERE candidate < control) AS wins, (SELECT 1 - avg(candidate) / avg(control) FROM runs) AS improvement,
      (SELECT max(candidate / control - 1) FROM fields) AS worst, (SELECT quantile_cont(gain, 0.025) FROM draws) AS low)
    SELECT improvement, wins >= 2 AS improved_two_of_three, improvement >= 0.05 AS mean_improvement_at_least_5_percent, worst <= 0.02 AS delivered_fields_within_2_percent, low > 0 AS positive_bootstrap_interval,
      CASE WHEN wins >= 2 AND improvement >= 0.05 AND worst <= 0.02 AND low > 0 THEN 'eligible_for_further_acceptance' ELSE 'retain_control' END AS decision FROM g""", views=LONG, doubles="improvement")
def _(v):
    of = lambda model, c: F.avg(F.when(F.col("model") == model, c))
    s = cut_lineage(pscores(v))
    runs = s.groupBy("split").agg(of("constant", F.col("p2")).alias("control"), of("linear", F.col("p2")).alias("candidate"))
    fields = s.select("model", F.explode(F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(c).alias("raw_error")) for n, c in zip(DELIVERED, ("exposure_error", "recovery_error"))])).alias("e"))
    fields = fields.select("model", "e.*").groupBy("parameter").agg(
        of("constant", F.abs("raw_error")).alias("control"), of("linear", F.abs("raw_error")).alias("candidate"))
    return G.promotion_gates(runs, fields, G.paired_bootstrap(group_errors(v, s), DRAWS, 7, width=BUCKET))


RULES = [("lower_mae", "mae", "<=", "constant", 1.0, 0.0), ("rmse_within_110pct", "rmse", "<=", "constant", 1.1, 0.0), ("mae_below_limit", "mae", "<=", None, 0.0, 5.0)]
LABELLED = ERRORS + """,
    lab AS (SELECT model AS label, 'mae' AS metric, avg(abs(raw_error)) AS value FROM errors GROUP BY model
      UNION ALL SELECT model, 'rmse', sqrt(avg(raw_error * raw_error)) FROM errors GROUP BY model)"""


def labelled(v):
    m = M.regression_metrics(errors(v).withColumn("parameter", F.lit("all")), ["model"])
    return m.select(F.col("model").alias("label"), F.expr("stack(2, 'mae', mae, 'rmse', rmse) AS (metric, value)"))


@check("a36_numeric_gates", "WITH " + LABELLED + """
    SELECT gate, c.value, coalesce(b.value * factor, 0) + offs AS "limit", c.value <= coalesce(b.value * factor, 0) + offs AS passed
    FROM (VALUES ('lower_mae', 'mae', 'constant', 1.0, 0.0), ('rmse_within_110pct', 'rmse', 'constant', 1.1, 0.0), ('mae_below_limit', 'mae', NULL, 0.0, 5.0)) r(gate, metric, base, factor, offs)
    JOIN lab c ON c.metric = r.metric AND c.label = 'linear' LEFT JOIN lab b ON b.metric = r.metric AND b.label = r.base""", views=LONG, doubles='value "limit"')
def _(v):
    return G.numeric_gates(labelled(v), "linear", RULES)


@check("a36_seeds_beating", "WITH " + LABELLED + """, one AS (SELECT max(value) FILTER (WHERE label = 'linear') AS best, list(value) FILTER (WHERE label IN ('constant', 'linear')) AS seeds FROM lab WHERE metric = 'mae')
    SELECT CAST(len(list_filter(seeds, lambda x: x > best)) AS BIGINT) AS better, len(list_filter(seeds, lambda x: x > best)) >= 1 AS passed FROM one""", views=LONG)
def _(v):
    return G.seeds_beating(labelled(v), ["constant", "linear"], ["linear"], "mae", need=1)


# ------------------------------------------------------------------ scalar functions

@check("f5_mired", "SELECT photo, expert, 1e6 / temperature AS mired FROM expert_labels", views="expert_labels", doubles="mired")
def _(v):
    return v.expert_labels.select("photo", "expert", K.mired(F.col("temperature")).alias("mired"))


@check("f13_vectors", """
    SELECT vec_id, sum(v * v) AS dot, sqrt(sum(v * v)) AS norm, sum(v * w) / (sqrt(sum(v * v)) * sqrt(sum(w * w))) AS cosine, bool_and(isfinite(v)) AS finite
    FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(list_reverse(embedding))::DOUBLE AS w FROM embeddings) q GROUP BY vec_id""", doubles="dot norm cosine")
def _(v):
    e = F.col("embedding")
    return v.embeddings.select("vec_id", AR.dot(e, e).alias("dot"), AR.norm(e).alias("norm"), AR.cosine(e, F.reverse(e)).alias("cosine"), AR.all_finite(e).alias("finite"))


@check("f17_psnr", "SELECT event_id, -10 * log10(greatest(abs(value) / 1e4, 1e-15)) AS psnr FROM events", doubles="psnr")
def _(v):
    return v.events.select("event_id", K.psnr(F.abs("value") / 1e4).alias("psnr"))


@check("f18_center_of_bins", "SELECT vec_id, sum(h * (i - 0.5) * 100 / 32) AS lightness FROM (SELECT vec_id, unnest(embedding[1:32])::DOUBLE AS h, generate_subscripts(embedding[1:32], 1) AS i FROM embeddings) q GROUP BY vec_id", doubles="lightness")
def _(v):
    return v.embeddings.select("vec_id", AR.center_of_bins(F.col("embedding")).alias("lightness"))
