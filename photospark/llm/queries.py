"""Registered queries of the operators over the driver tables, and their SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from photospark.llm import centroids, chat, decontaminate, language, lines, near, packing, quality, resampling, resharding, tournament, toxicity, urls
from photospark.llm.stage import Stage

TOKENIZER = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}.parquet")


def op4_vector_best_fit(spark: SparkSession, path: str) -> DataFrame:
    return packing.pack(table(spark, path, "documents"), TOKENIZER, Stage(spark, "packing"))


def op5_flow_resharding(spark: SparkSession, path: str) -> DataFrame:
    out = resharding.reshard_files(table(spark, path, "documents"), F.col("source"), Stage(spark, "shards"), 24)
    return out.withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})


def op6_url_rules(spark: SparkSession, path: str) -> DataFrame:
    lists = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
    labels = table(spark, path, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("blocked"))
    return urls.filter_urls(table(spark, path, "pages"), labels, lists, Stage(spark, "urls"), fold=3, min_confidence=0.0, min_lift=1.5)


def op8_fuzzy_lines(spark: SparkSession, path: str) -> DataFrame:
    out = lines.dedup_lines(table(spark, path, "documents").select("doc_id", "text"), Stage(spark, "lines"))
    return out.select("doc_id", "n_lines", "dropped", F.length("text").cast("long").alias("n_chars_left"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"))


def op9_chat_format(spark: SparkSession, path: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    rows = table(spark, path, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT CAST(-7 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '{tricky}' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)")
    return chat.digest(chat.format_conversations(rows.unionByName(extra)))


def op1_string_tiling(spark: SparkSession, path: str) -> DataFrame:
    return decontaminate.judge(table(spark, path, "documents"), table(spark, path, "benchmark"))


def op2_isolation_rules(spark: SparkSession, path: str) -> DataFrame:
    return quality.judge(table(spark, path, "documents"), table(spark, path, "labels"), Stage(spark, "quality"))


def op10_hyper_language(spark: SparkSession, path: str) -> DataFrame:
    docs = table(spark, path, "documents").select("doc_id", "text", "lang")
    held = remainder("doc_id", 3) == 1
    model = language.fit_prototypes(docs.where(~held))
    out = language.predict(docs, *model)
    return out.withColumn("held_out", remainder("doc_id", 3) == 1)


def op3_circulant_minhash(spark: SparkSession, path: str) -> DataFrame:
    return near.near_duplicates(table(spark, path, "documents"), Stage(spark, "near"))


def op7_toxic_grammar(spark: SparkSession, path: str) -> DataFrame:
    """Learned from at most about 40,000 labelled rows of the training folds, taken by hash: the bound of the fit."""
    docs = table(spark, path, "documents").select("doc_id", "text")
    labels = table(spark, path, "labels").where("toxic IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "toxic").where(remainder("doc_id", 5) != 0)
    share = 40_000 / max(1, labels.count())
    drawn = labels.where(F.pmod(F.xxhash64("doc_id", F.lit("toxic")), F.lit(1_000_000)) < share * 1_000_000)
    taught = Stage(spark, "toxic").write(docs.join(drawn, "doc_id"), "taught")
    out = toxicity.score(docs, *toxicity.fit(taught))
    return out.withColumn("held_out", remainder("doc_id", 5) == 0)


def op11_hilbert_centroids(spark: SparkSession, path: str) -> DataFrame:
    return centroids.cluster(table(spark, path, "embeddings"), Stage(spark, "centroids"))


def op12_tournament_packing(spark: SparkSession, path: str) -> DataFrame:
    return tournament.digest(tournament.pack(table(spark, path, "documents"), TOKENIZER, Stage(spark, "tournament")))


def op13_importance_resampling(spark: SparkSession, path: str) -> DataFrame:
    out = resampling.resample(table(spark, path, "documents"), table(spark, path, "benchmark"), Stage(spark, "resampling"))
    return out.select("doc_id", "n_features", "weight", "score", "rank", "n_words")


def remainder(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; null ids count as 0."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(n)), F.lit(0))


SQL = {}
SQL["op9_chat_format"] = f"""
WITH all_rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, {{esc_text}} AS safe, {{esc_role}} AS safe_role,
    row_number() OVER w AS n, lag(role) OVER w AS before
  FROM all_rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
sized AS (
  SELECT *, length(safe) + CASE WHEN n > 1 AND before = role THEN length('{chat.NEXT}')
    ELSE length(safe_role) + length('{chat.OPEN}') + length('{chat.HEAD}') + length('</s>') + 1 END AS chars FROM escaped)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""


def _sql_escape(column: str) -> str:
    out = f"replace({column}, '{chat.ESCAPE}', '{chat.ESCAPE}0')"
    for k, control in enumerate(chat.CONTROLS, 1):
        out = f"replace({out}, '{control}', '{chat.ESCAPE}{k}')"
    return out


SQL["op9_chat_format"] = SQL["op9_chat_format"].format(esc_text=_sql_escape("text"), esc_role=_sql_escape("role"))


def _sql_centroids(many: int = 16, rounds: int = 3) -> str:
    """The rounds written out; components are whole numbers in doubles, so every sum and product is exact."""
    def assigned(k: int) -> str:
        return f"""a{k} AS (
  SELECT v.r, v.vec_id, v.v, min([list_inner_product(v.v, v.v) - 2 * list_inner_product(v.v, c.v) + list_inner_product(c.v, c.v), c.c]) AS best
  FROM kept v CROSS JOIN c{k} c GROUP BY v.r, v.vec_id, v.v)"""

    parts = [f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, [floor({centroids.SCALE}.0 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE len(embedding) = {centroids.WIDTH} AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)""",
             f"""c0 AS MATERIALIZED (
  SELECT CAST(n - 1 AS DOUBLE) AS c, v FROM (SELECT v, row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, v) AS n FROM kept) WHERE n <= {many})"""]
    for k in range(rounds):
        parts.append(assigned(k))
        parts.append(f"""m{k} AS (
  SELECT c, list(x ORDER BY i) AS v FROM (
    SELECT best[2] AS c, i, floor(sum(v[i]) / count(*)) AS x FROM a{k}, range(1, {centroids.WIDTH + 1}) AS t(i) GROUP BY 1, 2) GROUP BY c)""")
        parts.append(f"c{k + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m ON c.c = m.c)")
    parts.append(assigned(rounds))
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.best[2] AS INTEGER) AS cluster, CAST(a.best[1] AS BIGINT) AS distance,
  CAST(sum(a.best[1]) OVER (PARTITION BY a.best[2]) AS BIGINT) AS cluster_inertia, CAST(sum(a.best[1]) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string([CAST(CAST(x AS BIGINT) AS VARCHAR) FOR x IN c.v], ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON c.c = a.best[2]
"""


SQL["op11_hilbert_centroids"] = _sql_centroids()
QUERIES = {f.__name__: f for f in (op1_string_tiling, op2_isolation_rules, op3_circulant_minhash, op4_vector_best_fit, op5_flow_resharding, op6_url_rules, op7_toxic_grammar, op8_fuzzy_lines, op9_chat_format, op10_hyper_language, op11_hilbert_centroids, op12_tournament_packing, op13_importance_resampling)}
