"""Label extraction, validation and catalog joins against their SQL twins."""

import uuid

from pyspark.sql import functions as F

from photospark.checks.registry import check
from photospark.contract import FINE_TUNING_LIMITS, NAMES, PARAMETERS
from photospark.operators import labels as L
from photospark.sources import catalog as C
from photospark.functions import text as X
from photospark.session import ensure_checkpoint_dir

CONTRACT = "(VALUES " + ", ".join(f"({i}, '{n}', CAST({lo} AS DOUBLE), CAST({hi} AS DOUBLE))" for i, (n, lo, hi) in enumerate(PARAMETERS)) + ") AS c(ord, parameter, lo, hi)"
# per-photo consensus of experts A-C, complete and inside the contract
TARGETS = f"""
    per AS (SELECT photo, parameter, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS n, count(DISTINCT expert) AS k,
                   count(*) FILTER (WHERE NOT (value BETWEEN lo AND hi)) AS bad
            FROM labels_long JOIN {CONTRACT} USING (parameter) WHERE expert IN ('A','B','C') GROUP BY photo, parameter),
    good AS (SELECT photo FROM per GROUP BY photo HAVING count(*) = 6 AND min(n) = 3 AND max(n) = 3 AND min(k) = 3 AND sum(bad) = 0),
    targets AS (SELECT per.photo, parameter, mean, std FROM per JOIN good USING (photo))"""
EXPERTS = ["A", "B", "C"]
# A line number pair can repeat a photo's expert, so expert records are read per (photo, expert).
CATALOG = ["collection", "collection_image", "image", "file", "develop", "exif", "camera", "keyword", "keyword_image"]


def scratch(v):
    """A new folder beside the checkpoints."""
    ensure_checkpoint_dir(v.spark)
    return f"{v.spark.sparkContext.getCheckpointDir().rstrip('/')}/{uuid.uuid4().hex}"


def cat(v):
    return {n: getattr(v, "cat_" + n) for n in CATALOG}


def targets(v):
    return L.expert_targets(v.labels_long, EXPERTS)


@check("s1_scan_catalog", "SELECT name, count(*) AS n FROM cat_collection JOIN cat_collection_image ON collection = id GROUP BY name",
       views="cat_collection cat_collection_image")
def _(v):
    path, tables = scratch(v), cat(v)
    for name in ("collection", "collection_image"):
        tables[name].write.parquet(f"{path}/{name}")
    read = C.scan_catalog(v.spark, path, ["collection", "collection_image"])
    joined = read["collection"].join(read["collection_image"].withColumnRenamed("collection", "id"), "id")
    return joined.groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@check("s5_feature_contract", """
    SELECT count(*) AS n, count(*) FILTER (WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: NOT isfinite(e))) = 0) AS ok,
           count(*) - count(DISTINCT vec_id) AS repeated FROM embeddings""")
def _(v):
    f = v.embeddings.select(F.col("vec_id").cast("string").alias("photo_id"), F.col("embedding").alias("x"),
                            F.slice("embedding", 1, 6).alias("y"), F.transform(F.slice("embedding", 1, 6), lambda e: F.abs(e)).alias("y_std"))
    rows = f.agg(F.count(F.lit(1)).alias("n"), F.count_if(C.feature_contract(64)).alias("ok"))
    repeated = C.duplicate_ids(f).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("r")).scalar()
    return rows.withColumn("repeated", repeated)


@check("s6_require_manifest", "SELECT count(*) AS n FROM photos", views="photos")
def _(v):
    f = v.photos.select("photo_id").withColumn("config_hash", F.lit("c1"))
    manifest = v.region.where("r_regionkey = 0").select(F.lit("complete").alias("status"), F.lit("full").alias("scope"), F.lit("c1").alias("config_hash"))
    unsupported = v.customer.select(F.lower("c_name").alias("photo_id"))
    return C.require_manifest(f, manifest, unsupported).agg(F.count(F.lit(1)).alias("n"))


@check("s8_scrape_listing", r"""
    SELECT page_id, pos - 1 AS pos, regexp_extract(block, 'href="([^"]*)"', 1) AS link, regexp_extract(block, '>([^<]*)</a>', 1) AS title
    FROM (SELECT page_id, unnest(regexp_extract_all(html, '<li><a [^>]*>[^<]*</a></li>')) AS block,
                 generate_subscripts(regexp_extract_all(html, '<li><a [^>]*>[^<]*</a></li>'), 1) AS pos FROM listing) q""", views="listing")
def _(v):
    out = C.scrape_listing(v.listing.select("page_id", "html"), r"<li><a [^>]*>[^<]*</a></li>",
                           {"link": r'href="([^"]*)"', "title": r">([^<]*)</a>"})
    return out.withColumn("pos", F.col("pos").cast("long"))


SETTINGS = """
    SELECT o_orderkey AS id, '{p}' AS parameter, CAST({value} AS DOUBLE) AS value, {source} AS source
    FROM settings_parts WHERE flaw = 'ok'"""
RESOLVED = " UNION ALL ".join([
    SETTINGS.format(p="Exposure", value="ev", source="'develop_settings.Exposure'"),
    SETTINGS.format(p="Contrast", value="con", source="'develop_settings.Contrast'"),
    SETTINGS.format(p="Saturation", value="CASE WHEN has_sat THEN sat ELSE 0 END",
                    source="CASE WHEN has_sat THEN 'develop_settings.Saturation' ELSE 'catalog_verified_omitted_zero.Saturation' END"),
    SETTINGS.format(p="Temperature", value="CASE WHEN wb = 'Custom' AND has_custom THEN temp + 1 ELSE temp END",
                    source="CASE WHEN wb = 'Custom' AND has_custom THEN 'develop_settings.CustomTemperature' ELSE 'develop_settings.Temperature' END"),
    SETTINGS.format(p="Tint", value="CASE WHEN wb = 'Custom' AND has_custom THEN tint + 1 ELSE tint END",
                    source="CASE WHEN wb = 'Custom' AND has_custom THEN 'develop_settings.CustomTint' ELSE 'develop_settings.Tint' END"),
    SETTINGS.format(p="HighlightRecovery", value="CASE WHEN has_rec THEN rec ELSE 0 END",
                    source="CASE WHEN has_rec THEN 'develop_settings.HighlightRecovery' ELSE 'catalog_verified_omitted_zero.HighlightRecovery' END"),
])


def parsed(v):
    return L.parse_settings(v.settings_text.select(F.col("o_orderkey").alias("id"), F.col("settings").alias("text")), "text")


def resolved(v):
    return L.resolve_fields(parsed(v).where("error IS NULL"), {"Saturation": 0.0, "HighlightRecovery": 0.0})


@check("p1_parse_settings", """
    SELECT o_orderkey AS id, CASE flaw WHEN 'ok' THEN '' WHEN 'duplicate' THEN 'bad or repeated entry'
             WHEN 'unclosed' THEN 'open string or table' ELSE 'no scalar in Sharp' END AS error,
           CASE WHEN flaw = 'ok' THEN 11 + CAST(has_sat AS INT) + 2 * CAST(has_custom AS INT) + CAST(has_rec AS INT) + CAST(has_process AS INT) ELSE 0 END AS fields,
           CASE WHEN flaw = 'ok' THEN wb ELSE '' END AS wb, CASE WHEN flaw = 'ok' THEN 'a, b} {c' ELSE '' END AS note,
           CASE WHEN flaw = 'ok' THEN CAST(tint AS DOUBLE) ELSE 0 END AS tint
    FROM settings_parts""", views="settings_parts", doubles="tint")
def _(v):
    value = lambda k, f: F.element_at("fields", k)[f]
    return parsed(v).select(
        "id", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(F.size("fields"), F.lit(0)).alias("fields"),
        F.coalesce(value("WhiteBalance", "str"), F.lit("")).alias("wb"), F.coalesce(value("Note", "str"), F.lit("")).alias("note"),
        F.coalesce(value("Tint", "num"), F.lit(0.0)).alias("tint"))


check("p2_resolve_fields", RESOLVED, views="settings_parts", doubles="value")(resolved)


@check("p3_process_family", """
    SELECT o_orderkey AS id, CASE WHEN has_process OR ver IN ('4.5','5.3','5.4') THEN 'PV2003' ELSE '' END AS family,
           CASE WHEN has_process THEN 'explicit ProcessVersion' WHEN ver IN ('4.5','5.3','5.4') THEN 'inferred from pre-5.7 Camera Raw Version ' || ver
                ELSE 'unverified process/version combination' END AS family_source
    FROM settings_parts WHERE flaw = 'ok'""", views="settings_parts")
def _(v):
    out = L.process_family(parsed(v).where("error IS NULL"))
    return out.select("id", F.coalesce("family", F.lit("")).alias("family"), "family_source")


@check("p4_validate_parameters", f"""
    SELECT photo, expert, CASE WHEN count(*) < 6 THEN 'missing or non-finite'
             WHEN count(*) FILTER (WHERE NOT (value BETWEEN lo AND hi)) > 0 THEN 'outside declared range' ELSE '' END AS reason
    FROM labels_long JOIN {CONTRACT} USING (parameter) GROUP BY photo, expert""", views="labels_long")
def _(v):
    return L.validate_parameters(v.labels_long, ["photo", "expert"]).select("photo", "expert", "reason")


@check("p5_nonblank", "SELECT id, image FROM cat_develop WHERE length(trim(text)) > 0", views="cat_develop")
def _(v):
    return L.drop_blank(v.cat_develop, "text").select("id", "image")


@check("p6_validate_ids", r"""
    SELECT photo_id, count(*) AS n, CASE WHEN photo_id <> lower(photo_id) OR NOT regexp_full_match(photo_id, '[^/\\\x00-\x1f\x7f]+\.dng')
             THEN 'unsafe or non-canonical' WHEN count(*) > 1 THEN 'duplicate' ELSE '' END AS reason
    FROM (SELECT photo_id FROM photos UNION ALL SELECT c_name || '.dng' FROM customer UNION ALL SELECT replace(url, 'http:', '') || '.dng' FROM pages
          UNION ALL SELECT lower(c_mktsegment) || '.dng' FROM customer) q
    GROUP BY photo_id""", views="photos")
def _(v):
    dng = lambda c: F.concat(c, F.lit(".dng")).alias("photo_id")
    ids = (v.photos.select("photo_id").unionByName(v.customer.select(dng(F.col("c_name"))))
           .unionByName(v.pages.select(dng(F.replace("url", F.lit("http:"), F.lit("")))))
           .unionByName(v.customer.select(dng(F.lower("c_mktsegment")))))
    return L.validate_ids(ids)


@check("p7_quarantine", f"""
    SELECT photo, string_agg(reason, '; ' ORDER BY reason) AS reasons FROM (
      SELECT DISTINCT photo, expert || ': outside declared range' AS reason FROM labels_long JOIN {CONTRACT} USING (parameter) WHERE NOT (value BETWEEN lo AND hi)
      UNION SELECT photo, expert || ': repeated record' FROM expert_labels GROUP BY photo, expert HAVING count(*) > 1) q
    GROUP BY photo""", views="labels_long expert_labels")
def _(v):
    return L.quarantine(label_errors(v), "photo").select("photo", F.array_join("reasons", "; ").alias("reasons"))


def label_errors(v):
    bad = L.validate_parameters(v.labels_long, ["photo", "expert"]).where("reason <> ''")
    repeated = v.expert_labels.groupBy("photo", "expert").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return bad.select("photo", F.concat("expert", F.lit(": "), "reason").alias("reason")).unionByName(
        repeated.select("photo", F.concat("expert", F.lit(": repeated record")).alias("reason")))


@check("p8_normalize", TARGETS.strip().replace("per AS", "WITH per AS", 1) + f"""
    SELECT photo, parameter, 2 * (mean - lo) / (hi - lo) - 1 AS normalized, mean AS value FROM targets JOIN {CONTRACT} USING (parameter)""",
       views="labels_long", doubles="normalized value")
def _(v):
    scaled = L.normalize(targets(v), "mean")
    return L.denormalize(scaled).select("photo", "parameter", "normalized", "value")


@check("p9_split_recommended", "WITH " + TARGETS + """
    SELECT parameter, CASE WHEN parameter IN ('Exposure', 'HighlightRecovery') THEN 'recommended' ELSE 'experimental' END AS tier, count(*) AS n
    FROM targets GROUP BY parameter""", views="labels_long")
def _(v):
    tiers = L.split_recommended(targets(v), ["Exposure", "HighlightRecovery"])
    return tiers.groupBy("parameter", "tier").agg(F.count(F.lit(1)).alias("n"))


@check("p14_validate_settings", """
    SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'unknown setting'
        WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) > 20 THEN 'invalid warmth'
        WHEN value / 100 <> floor(value / 100) OR value > 2000 OR value < -2000 THEN 'invalid tint' ELSE '' END AS problem FROM events""")
def _(v):
    k = F.get_json_object("props", "$.k").cast("double")
    key = F.when(F.col("event_type") == "error", "glow").otherwise("warmth")
    settings = F.map_from_arrays(F.array(key, F.lit("tint")), F.array(k, F.col("value") / 100))
    df = v.events.select(F.col("event_id").alias("id"), settings.alias("m"))
    return L.validate_settings(df, "m", FINE_TUNING_LIMITS).select("id", "problem")


# ------------------------------------------------------------------ joins

J1 = """SELECT ci.collection, i.root_file, f.filename, i.id AS image_id, d.id AS develop_id, d.history_id, d.text
        FROM cat_collection_image ci JOIN cat_image i ON i.id = ci.image JOIN cat_file f ON f.id = i.root_file
        LEFT JOIN cat_develop d ON d.image = i.id"""
CATV = "cat_collection_image cat_image cat_file cat_develop"
PHOTO_IMAGES = "pim AS (SELECT i.id AS image, lower(trim(f.filename)) AS photo_id FROM cat_image i JOIN cat_file f ON f.id = i.root_file)"


@check("j1_expert_records", f"SELECT collection, root_file, filename, image_id, coalesce(develop_id, -1) AS develop_id, coalesce(history_id, -1) AS history_id, coalesce(text, '-') AS text FROM ({J1}) q", views=CATV)
def _(v):
    out = L.expert_records(cat(v))
    return out.select("collection", "root_file", "filename", "image_id", F.coalesce("develop_id", F.lit(-1).cast("long")).alias("develop_id"),
                      F.coalesce("history_id", F.lit(-1).cast("long")).alias("history_id"), F.coalesce("text", F.lit("-")).alias("text"))


@check("j2_camera_of", f"""
    WITH {PHOTO_IMAGES} SELECT photo_id, CASE WHEN count(DISTINCT trim(c.value)) = 1 THEN min(trim(c.value)) ELSE 'ambiguous' END AS camera
    FROM pim JOIN cat_exif e ON e.image = pim.image JOIN cat_camera c ON c.id = e.camera_ref GROUP BY photo_id""",
       views="cat_image cat_file cat_exif cat_camera")
def _(v):
    return L.camera_of(cat(v))


@check("j3_tags_of", f"""
    WITH {PHOTO_IMAGES} SELECT DISTINCT photo_id, k.name AS keyword FROM pim JOIN cat_keyword_image ki ON ki.image = pim.image
    JOIN cat_keyword k ON k.id = ki.tag WHERE k.name IS NOT NULL""", views="cat_image cat_file cat_keyword cat_keyword_image")
def _(v):
    return L.tags_of(cat(v))


@check("j4_as_shot", f"""
    WITH one AS (SELECT lower(trim(filename)) AS photo_id, min(develop_id) AS id FROM ({J1}) q WHERE length(trim(text)) > 0 GROUP BY 1 HAVING count(*) = 1)
    SELECT photo_id, CAST(CASE WHEN wb = 'Custom' AND has_custom THEN temp + 1 ELSE temp END AS DOUBLE) AS temperature,
           CAST(CASE WHEN wb = 'Custom' AND has_custom THEN s.tint + 1 ELSE s.tint END AS DOUBLE) AS tint
    FROM one JOIN settings_parts s ON s.o_orderkey = one.id
    WHERE flaw = 'ok' AND CASE WHEN wb = 'Custom' AND has_custom THEN temp + 1 ELSE temp END BETWEEN 2000 AND 50000
      AND CASE WHEN wb = 'Custom' AND has_custom THEN s.tint + 1 ELSE s.tint END BETWEEN -150 AND 150""",
       views=CATV + " settings_parts", doubles="temperature tint")
def _(v):
    return L.as_shot(cat(v))


@check("j5_capture_context", f"""
    WITH {PHOTO_IMAGES}, seen AS (SELECT DISTINCT photo_id, trim(c.value) AS camera, serial, capture_time FROM pim JOIN cat_exif e ON e.image = pim.image
      JOIN cat_camera c ON c.id = e.camera_ref),
    one AS (SELECT photo_id, min(camera) AS camera, min(serial) AS serial, min(capture_time) AS t FROM seen GROUP BY photo_id HAVING count(*) = 1)
    SELECT p.photo_id, coalesce(camera, '-') AS camera, coalesce(serial, -1) AS serial, coalesce(t, '-') AS captured
    FROM (SELECT DISTINCT photo_id FROM pim) p LEFT JOIN one USING (photo_id)""", views="cat_image cat_file cat_exif cat_camera")
def _(v):
    tables = cat(v)
    photos = tables["file"].select(F.lower("filename").alias("photo_id")).distinct()
    out = L.capture_context(tables, photos)
    return out.select("photo_id", F.coalesce("camera", F.lit("-")).alias("camera"), F.coalesce("serial", F.lit(-1)).alias("serial"),
                      F.coalesce(F.date_format("captured", "yyyy-MM-dd HH:mm:ss"), F.lit("-")).alias("captured"))


@check("j10_join_annotations", "SELECT n_nationkey, n_name, r.nation, r.suppliers FROM nation JOIN (SELECT lower(n_name) AS nation, count(*) AS suppliers FROM nation JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1) r ON r.nation = lower(n_name)")
def _(v):
    counted = v.nation.join(v.supplier, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.lower("n_name").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return L.join_annotations(v.nation.select("n_nationkey", "n_name"), counted, "n_name", "nation")


@check("j11_valid_labels", f"""
    WITH refused AS MATERIALIZED (
      SELECT photo FROM labels_long JOIN {CONTRACT} USING (parameter) WHERE NOT (value BETWEEN lo AND hi)
      UNION SELECT photo FROM expert_labels GROUP BY photo, expert HAVING count(*) > 1)
    SELECT photo, expert, parameter, value FROM labels_long l WHERE NOT EXISTS (SELECT 1 FROM refused r WHERE r.photo = l.photo)""", views="labels_long expert_labels", doubles="value")
def _(v):
    return L.valid_labels(v.labels_long, L.quarantine(label_errors(v), "photo"), "photo").select("photo", "expert", "parameter", "value")


VERSIONS = """old AS (SELECT photo, parameter, max(value) AS value FROM labels_long WHERE expert IN ('A', 'B') GROUP BY photo, parameter),
              new AS (SELECT photo, parameter, max(value) AS value FROM labels_long WHERE expert IN ('B', 'C') GROUP BY photo, parameter)"""


def version(v, *experts):
    return v.labels_long.where(F.col("expert").isin(*experts)).groupBy("photo", "parameter").agg(F.max("value").alias("value"))


@check("j18_diff_labels", f"""
    WITH {VERSIONS} SELECT coalesce(o.photo, n.photo) AS photo, coalesce(o.parameter, n.parameter) AS parameter,
        coalesce(o.value, -9999) AS old, coalesce(n.value, -9999) AS new,
        CASE WHEN o.photo IS NULL THEN 'added' WHEN n.photo IS NULL THEN 'removed' ELSE 'changed' END AS change
    FROM old o FULL JOIN new n ON n.photo = o.photo AND n.parameter = o.parameter WHERE o.value IS DISTINCT FROM n.value""",
       views="labels_long", doubles="old new")
def _(v):
    out = L.diff_labels(version(v, "A", "B"), version(v, "B", "C"), ["photo", "parameter"])
    return out.fillna(-9999.0, ["old", "new"]).select("photo", "parameter", "old", "new", "change")


# ------------------------------------------------------------------ aggregates

@check("a1_exactly_one", f"""
    SELECT collection, lower(filename) AS photo_id, count(*) AS records, count(*) FILTER (WHERE length(trim(text)) > 0) AS filled,
      CASE WHEN count(*) FILTER (WHERE length(trim(text)) > 0) <> 1 THEN 'expected exactly one nonempty record, found ' || count(*) FILTER (WHERE length(trim(text)) > 0) ELSE '' END AS reason,
      CASE WHEN count(*) FILTER (WHERE length(trim(text)) > 0) = 1 THEN max(CASE WHEN length(trim(text)) > 0 THEN develop_id END) ELSE -1 END AS develop_id
    FROM ({J1}) q GROUP BY 1, 2""", views=CATV)
def _(v):
    rec = L.expert_records(cat(v)).withColumn("photo_id", F.lower("filename")).select("collection", "photo_id", "develop_id", "text")
    out = L.exactly_one(rec, ["collection", "photo_id"])
    return out.select("collection", "photo_id", "records", "filled", "reason", F.coalesce("develop_id", F.lit(-1).cast("long")).alias("develop_id"))


@check("a2_audit_counts", f"""
    SELECT 'query_rows' AS counter, count(*) AS n FROM ({J1}) q UNION ALL SELECT 'empty_records', count(*) FILTER (WHERE coalesce(length(trim(text)), 0) = 0) FROM ({J1}) q
    UNION ALL SELECT 'nonempty_records', count(*) FILTER (WHERE length(trim(text)) > 0) FROM ({J1}) q
    UNION ALL SELECT source, count(*) FROM ({RESOLVED}) r GROUP BY source""", views=CATV + " settings_parts")
def _(v):
    return L.audit_counts(L.expert_records(cat(v)), resolved(v))


@check("a3_distributions", """
    SELECT 'WhiteBalance' AS name, wb AS value, count(*) AS n FROM settings_parts WHERE flaw = 'ok' GROUP BY wb
    UNION ALL SELECT 'ProcessVersion', CASE WHEN has_process THEN '5.0' ELSE 'omitted' END, count(*) FROM settings_parts WHERE flaw = 'ok' GROUP BY 2
    UNION ALL SELECT 'Version', ver, count(*) FROM settings_parts WHERE flaw = 'ok' GROUP BY ver""", views="settings_parts")
def _(v):
    names = ["WhiteBalance", "ProcessVersion", "Version"]
    ok = parsed(v).where("error IS NULL")
    return L.distributions(ok.select(*[F.element_at("fields", n)["str"].alias(n) for n in names]), names)


@check("a3_distribution_sets", """
    SELECT coalesce(camera, '*') AS camera, coalesce(status, '*') AS status, count(*) AS n, CAST(grouping_id(camera, status) AS BIGINT) AS level
    FROM photos GROUP BY GROUPING SETS ((camera), (status))""", views="photos")
def _(v):
    return L.distribution_sets(v.photos, ["camera", "status"]).fillna("*", ["camera", "status"])


check("a4_expert_targets", "WITH " + TARGETS + " SELECT photo, parameter, mean, std FROM targets", views="labels_long", doubles="mean std")(targets)


@check("a5_label_stats", "WITH " + TARGETS + """
    SELECT parameter, min(mean) AS mean_min, quantile_cont(mean, 0.01) AS mean_p1, quantile_cont(mean, 0.99) AS mean_p99, max(mean) AS mean_max,
      min(expert_min) AS expert_min, max(expert_max) AS expert_max
    FROM targets JOIN (SELECT parameter, min(value) AS expert_min, max(value) AS expert_max FROM labels_long WHERE expert IN ('A','B','C') AND photo IN (SELECT photo FROM good) GROUP BY parameter) e USING (parameter)
    GROUP BY parameter""", views="labels_long", doubles="mean_min mean_p1 mean_p99 mean_max expert_min expert_max")
def _(v):
    t = targets(v)
    used = v.labels_long.where(F.col("expert").isin(*EXPERTS)).join(t.select("photo").distinct(), "photo", "left_semi")
    return L.label_stats(t, used)


@check("a6_audit_defaults", """
    SELECT name, count(*) AS total, count(*) FILTER (WHERE stored IS NULL) AS omitted_zero, count(*) FILTER (WHERE stored IS NOT NULL) AS explicit,
      count(*) FILTER (WHERE coalesce(stored, 0) <> recorded) AS contradictions FROM edit_history GROUP BY name""", views="edit_history")
def _(v):
    return L.require_defaults(L.audit_defaults(v.edit_history))


@check("w7_examples", """SELECT name, id, rank FROM (SELECT name, id, row_number() OVER (PARTITION BY name ORDER BY id) AS rank FROM edit_history WHERE stored IS NULL) q WHERE rank <= 3""", views="edit_history")
def _(v):
    return L.examples(v.edit_history.where("stored IS NULL"), "name", "id").select("name", "id", F.col("rank").cast("long").alias("rank"))


@check("a7_missing_experts", """
    SELECT photo, string_agg(e, ',' ORDER BY e) AS missing FROM (SELECT DISTINCT photo FROM expert_labels) p
    CROSS JOIN (VALUES ('A'), ('B'), ('C'), ('D'), ('E')) x(e)
    WHERE NOT EXISTS (SELECT 1 FROM expert_labels l WHERE l.photo = p.photo AND l.expert = e) GROUP BY photo""", views="expert_labels")
def _(v):
    return L.missing_experts(v.expert_labels, list("ABCDE")).select("photo", F.array_join("missing", ",").alias("missing"))


@check("l8_with_provenance", "SELECT id, image, history_id, sha256(text) AS text_sha256 FROM cat_develop WHERE text IS NOT NULL", views="cat_develop")
def _(v):
    rows = L.with_provenance(v.cat_develop.where("text IS NOT NULL"), ["id", "image", "history_id"])
    return rows.select("provenance.*")


# ------------------------------------------------------------------ text functions

@check("f1_names", """
    SELECT o_orderkey, lower(trim(concat(' P', o_orderkey, '.Raw.DNG '))) AS id, concat('P', o_orderkey, '.Raw') AS stem, '.dng' AS suffix FROM orders""")
def _(v):
    name = F.concat(F.lit(" P"), F.col("o_orderkey").cast("string"), F.lit(".Raw.DNG "))
    return v.orders.select("o_orderkey", X.canonical_id(name).alias("id"), X.stem(F.trim(name)).alias("stem"), X.suffix(F.trim(name)).alias("suffix"))


@check("f2_links_and_text", r"""
    SELECT page_id, array_to_string(regexp_extract_all(html, 'href="([^"]+)"', 1), ' ') AS links,
      trim(regexp_replace(replace(replace(replace(regexp_replace(html, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g')) AS plain
    FROM pages""")
def _(v):
    return v.pages.select("page_id", F.array_join(X.links(F.col("html")), " ").alias("links"), X.strip_markup(F.col("html")).alias("plain"))


@check("f3_hashes", """SELECT doc_id, sha256(text) AS text_sha, sha256('{"a":"' || lang || '","b":"' || source || '"}') AS config_sha FROM documents""")
def _(v):
    config = F.map_from_arrays(F.array(F.lit("b"), F.lit("a")), F.array("source", "lang"))
    return v.documents.select("doc_id", X.text_hash(F.col("text")).alias("text_sha"), X.config_hash(config).alias("config_sha"))


@check("f4_times", """
    SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE epoch_us(o_orderdate) END AS micros,
           CASE WHEN o_orderkey % 10 = 0 THEN -1 ELSE CAST(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1992-01-01 00:00:00') AS DOUBLE) / 1e6 END AS gap FROM orders""", doubles="gap")
def _(v):
    raw = F.when(F.col("o_orderkey") % 10 == 0, "not a time").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    t = X.parse_time(raw)
    return v.orders.select("o_orderkey", F.coalesce(X.micros(t), F.lit(-1).cast("long")).alias("micros"),
                           F.coalesce(X.gap_seconds(F.lit("1992-01-01 00:00:00").cast("timestamp"), t), F.lit(-1.0)).alias("gap"))


@check("f14_json_and_maps", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_type AS unknown FROM events""")
def _(v):
    m = F.map_from_arrays(F.array(F.col("event_type"), F.lit("k")), F.array(F.lit(1), F.lit(2)))
    return v.events.select("event_id", X.json_path(F.col("props"), "$.k").cast("long").alias("k"), F.array_join(X.unknown_keys(m, ["k"]), ",").alias("unknown"))
