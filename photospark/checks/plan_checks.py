"""Whole plans against their SQL twins."""

from photospark.checks.eval_checks import BUCKETS, ERRORS, LONG, SUMMARY
from photospark.checks.group_checks import GREEDY
from photospark.checks.registry import check
from photospark.plans.evaluation import strata_report

SPLIT = GREEDY.strip() + ", gsplit AS (SELECT p.photo, w.split FROM walk w JOIN ordered o ON o.i = w.i JOIN photos p ON p.group_id = o.group_id), "


@check("strata_report", SPLIT + (ERRORS + ", " + BUCKETS).replace("split_of", "gsplit") + f"""
    SELECT bucket, model, CAST(count(*) / 6 AS BIGINT) AS photos, {SUMMARY}, count(*) / 6 < 10 AS small FROM errors JOIN buckets USING (photo) GROUP BY bucket, model""",
       views=LONG.replace("split_of", "photos") + " tags", doubles="macro_normalized_mae p2")
def strata(v):
    return strata_report(v.labels_long, v.features4, v.photos, v.tags, ["A", "B", "C"], "x0", "x3")
