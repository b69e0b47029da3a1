"""The library's input shapes derived from the driver tables, in one portable SQL text per view.

Every view covers its whole source table. The same text runs in Spark and in the SQL twin; only
table references and four macros differ.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from photospark.session import sound_unions

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

LETTERS = "abcdefghijklmnopqrstuvwxyz ,.01234"
CODE_PAIRS = [(i + 1, i) for i in range(32)], [(i, (i + 13) % 33) for i in range(32)]


def _letter(i: int) -> str:
    return f"(length(text) - length(replace(text, '{LETTERS[i]}', '')))"


def _bits(pairs) -> str:
    terms = []
    for i, (a, b) in enumerate(pairs):
        terms.append(f"(CASE WHEN {_letter(a)} > {_letter(b)} THEN CAST({1 << i} AS BIGINT) ELSE CAST(0 AS BIGINT) END)")
    return " + ".join(terms)


def _letter_hashes(batches):
    """(id, d, p) of batches (doc_id, text), as the SQL text of ``hashes`` has them: every text is counted in one pass over its bytes."""
    places = np.frombuffer(LETTERS.encode(), np.uint8)
    for batch in batches:
        texts = batch.column(1)
        counts = np.zeros((len(texts), len(places)), np.int64)
        for i, text in enumerate(texts):
            if text.is_valid:
                counts[i] = np.bincount(np.frombuffer(text.as_buffer(), np.uint8), minlength=256)[places]
        codes = [sum((counts[:, a] > counts[:, b]).astype(np.int64) << i for i, (a, b) in enumerate(pairs)) for pairs in CODE_PAIRS]
        yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, codes)], names=["id", "d", "p"])


def _channel(shift: int) -> str:
    return (
        f"CAST(floor((least(greatest(CAST(@elem(embedding, (i + {shift}) % 64) AS DOUBLE), CAST(-0.5 AS DOUBLE)), "
        "CAST(0.5 AS DOUBLE)) + CAST(0.5 AS DOUBLE)) * 255) AS INT)"
    )


VIEWS: dict[str, str] = {
    # five-expert style settings: 6 doubles per (photo, expert)
    "expert_labels": """
        SELECT l_orderkey AS photo, substr('ABCDEFG', l_linenumber, 1) AS expert,
               l_discount * 80 - 4 AS exposure, l_tax * 1875 - 50 AS contrast,
               (l_quantity - 1) * 200 / 49 - 100 AS saturation, l_extendedprice / 2 AS temperature,
               CAST(l_partkey % 301 AS DOUBLE) - 150 AS tint, CAST(l_suppkey % 101 AS DOUBLE) AS recovery
        FROM {lineitem}""",
    "labels_long": """
        SELECT photo, expert, 'Exposure' AS parameter, exposure AS value FROM expert_labels
        UNION ALL SELECT photo, expert, 'Contrast' AS parameter, contrast AS value FROM expert_labels
        UNION ALL SELECT photo, expert, 'Saturation' AS parameter, saturation AS value FROM expert_labels
        UNION ALL SELECT photo, expert, 'Temperature' AS parameter, temperature AS value FROM expert_labels
        UNION ALL SELECT photo, expert, 'Tint' AS parameter, tint AS value FROM expert_labels
        UNION ALL SELECT photo, expert, 'HighlightRecovery' AS parameter, recovery AS value FROM expert_labels""",
    "photos": """
        SELECT lower(concat('P', lpad(CAST(o_orderkey AS STRING), 8, '0'), '.DNG')) AS photo_id, o_orderkey AS photo,
               concat('g', CAST(o_custkey AS STRING)) AS group_id, o_orderpriority AS camera,
               o_orderstatus AS status, CAST(o_orderdate AS TIMESTAMP) AS captured, o_totalprice AS price
        FROM {orders}""",
    # a reproducible group-exclusive split (0-7 train, 8 val, 9 test)
    "split_of": """
        SELECT photo, photo_id, group_id,
               CASE WHEN @pick(group_id) % 10 < 8 THEN 'train' WHEN @pick(group_id) % 10 = 8 THEN 'val' ELSE 'test' END AS split
        FROM photos""",
    "features4": """
        SELECT l_orderkey AS photo, avg(l_quantity) AS x0, avg(l_discount) AS x1, avg(l_tax) AS x2,
               avg(l_extendedprice) AS x3
        FROM {lineitem} GROUP BY l_orderkey""",
    "tags": """
        SELECT DISTINCT l_orderkey AS photo, l_returnflag AS tag FROM {lineitem}""",
    # catalog tables
    "cat_collection": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM {nation}",
    "cat_collection_image": "SELECT CAST(c_nationkey AS BIGINT) AS collection, c_custkey AS image FROM {customer}",
    "cat_image": "SELECT c_custkey AS id, c_custkey + 7 AS root_file, c_mktsegment AS segment FROM {customer}",
    "cat_file": "SELECT c_custkey + 7 AS id, concat(c_name, '.DNG') AS filename FROM {customer}",
    "cat_develop": """
        SELECT o_orderkey AS id, o_custkey AS image, o_orderkey * 10 AS history_id,
               CASE WHEN o_orderkey % 13 = 0 THEN '  ' WHEN o_orderkey % 17 = 0 THEN CAST(NULL AS STRING) ELSE settings END AS text
        FROM settings_text""",
    "cat_exif": """
        SELECT l_orderkey AS image, l_suppkey % 7 AS camera_ref, l_linenumber % 3 AS serial,
               CAST(l_shipdate AS STRING) AS capture_time FROM {lineitem}""",
    "cat_camera": "SELECT s_suppkey AS id, concat(' ', s_name, ' ') AS value FROM {supplier}",
    "cat_keyword": "SELECT p_partkey AS id, p_brand AS name FROM {part}",
    "cat_keyword_image": "SELECT l_orderkey AS image, l_partkey AS tag FROM {lineitem}",
    # settings text in the catalog's table notation, one per order
    "settings_parts": """
        SELECT o_orderkey, o_custkey, o_orderkey % 9 - 4 AS ev, (o_orderkey % 151) - 50 AS con, (o_orderkey % 201) - 100 AS sat,
               2000 + (o_orderkey % 481) * 100 AS temp, (o_orderkey % 321) - 160 AS tint, o_orderkey % 101 AS rec,
               CASE WHEN o_orderkey % 3 = 0 THEN 'Custom' ELSE 'As Shot' END AS wb,
               o_orderkey % 6 <> 0 AS has_custom, o_orderkey % 5 <> 0 AS has_sat, o_orderkey % 7 <> 0 AS has_rec,
               CASE WHEN o_orderkey % 11 = 0 THEN '8.0' WHEN o_orderkey % 2 = 0 THEN '5.3' ELSE '4.5' END AS ver,
               o_orderkey % 4 = 0 AS has_process,
               CASE WHEN o_orderkey % 97 = 0 THEN 'duplicate' WHEN o_orderkey % 89 = 0 THEN 'unclosed'
                    WHEN o_orderkey % 83 = 0 THEN 'call' ELSE 'ok' END AS flaw
        FROM {orders}""",
    "settings_text": """
        SELECT o_orderkey, o_custkey, concat('s = { IncrementalTemperature = -3, WhiteBalance = "', wb, '", Nested = { Exposure = 99, Deep = { Tint = 1 } }, Exposure = ',
               CAST(ev AS STRING), ', Contrast = ', CAST(con AS STRING),
               CASE WHEN has_sat THEN concat(', Saturation = ', CAST(sat AS STRING)) ELSE '' END,
               ', Temperature = ', CAST(temp AS STRING), ', Tint = ', CAST(tint AS STRING),
               CASE WHEN has_custom THEN concat(', CustomTemperature = ', CAST(temp + 1 AS STRING), ', CustomTint = ', CAST(tint + 1 AS STRING)) ELSE '' END,
               CASE WHEN has_rec THEN concat(', HighlightRecovery = ', CAST(rec AS STRING)) ELSE '' END,
               CASE WHEN has_process THEN ', ProcessVersion = "5.0"' ELSE '' END,
               ', Version = "', ver, '", AutoTone = true, Profile = nil, Note = "a, b} {c"',
               CASE WHEN flaw = 'duplicate' THEN ', Exposure = 1' WHEN flaw = 'call' THEN ', Sharp = run(1)' ELSE '' END,
               CASE WHEN flaw = 'unclosed' THEN ', Open = { ' ELSE ' ' END, '}') AS settings
        FROM settings_parts""",
    "captures": "SELECT event_id AS id, user_id AS camera, CAST(ts AS TIMESTAMP) AS t FROM {events}",
    "edit_history": """
        SELECT event_id AS id, user_id AS image, event_type AS name, @jsonint(props, k) % 5 AS recorded,
               CASE WHEN @jsonint(props, k) % 5 = 0 THEN CAST(NULL AS BIGINT) ELSE @jsonint(props, k) % 5 END AS stored
        FROM {events}""",
    "history": """
        SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch, value AS val
        FROM {events}""",
    # perceptual codes from letter counts of the whole text
    "hashes": f"""
        SELECT doc_id AS id, {_bits([(i + 1, i) for i in range(32)])} AS d,
               {_bits([(i, (i + 13) % 33) for i in range(32)])} AS p
        FROM {{documents}}""",
    "listing": "SELECT page_id, url, html FROM {pages}",
    # 8x8 images from vectors; rows (photo, y, x, r, g, b)
    "pixels": f"""
        SELECT vec_id AS photo, CAST(floor(i / 8) AS INT) AS y, CAST(i % 8 AS INT) AS x,
               {_channel(0)} AS r, {_channel(21)} AS g, {_channel(42)} AS b
        FROM (SELECT vec_id, embedding, @each(i, 64) FROM {{embeddings}}) q""",
    # same images with a colour and brightness proposal
    "proposal": """
        SELECT photo, y, x, least(255, r + 24) AS r, g, greatest(0, b - 24) AS b FROM pixels""",
    # dim images with extreme corners, for guards
    "dim": """
        SELECT photo, y, x, CAST(floor(r / 3) AS INT) AS r, CAST(floor(g / 3) AS INT) AS g,
               CASE WHEN y = 0 AND x = 0 THEN 255 ELSE CAST(floor(b / 3) AS INT) END AS b FROM pixels""",
    "photo_params": """
        SELECT vec_id AS photo, CAST(vec_id % 9 AS DOUBLE) / 2 - 2 AS exposure, CAST(vec_id % 5 AS DOUBLE) * 25 AS recovery,
               CAST(vec_id % 4 AS DOUBLE) / 3 AS strength, CAST(vec_id % 7 AS DOUBLE) / 4 + 0.5 AS gamma,
               CAST(vec_id % 3 AS DOUBLE) / 20 - 0.05 AS tint
        FROM {embeddings}""",
    "label_means": """
        SELECT label, i AS pos, avg(CAST(@elem(embedding, i) AS DOUBLE)) AS v
        FROM (SELECT label, embedding, @each(i, 64) FROM {embeddings}) q GROUP BY label, i""",
    # cosine of each half of the vector with each label mean: labels 0-4 subject, 5-9 lighting
    "scores": """
        SELECT photo, view, CASE WHEN label < 5 THEN 'subject' ELSE 'lighting' END AS family, label,
               dp / sqrt(na * nb) AS score
        FROM (SELECT e.photo, CASE WHEN e.pos < 32 THEN 'center_crop' ELSE 'full_frame' END AS view, m.label,
                     sum(e.v * m.v) AS dp, sum(e.v * e.v) AS na, sum(m.v * m.v) AS nb
              FROM (SELECT vec_id AS photo, i AS pos, CAST(@elem(embedding, i) AS DOUBLE) AS v
                    FROM (SELECT vec_id, embedding, @each(i, 64) FROM {embeddings}) q) e
              JOIN label_means m ON m.pos = e.pos
              GROUP BY e.photo, CASE WHEN e.pos < 32 THEN 'center_crop' ELSE 'full_frame' END, m.label) s""",
}

def _spark_bits(pairs) -> str:
    return " + ".join(f"(CASE WHEN c[{a}] > c[{b}] THEN {1 << i}L ELSE 0L END)" for i, (a, b) in enumerate(pairs))


# the same rows in one scan, where the engine has a row generator for it
_SPARK_TEXT = {
    "labels_long": """
        SELECT photo, expert, parameter, value FROM expert_labels
        LATERAL VIEW stack(6, 'Exposure', exposure, 'Contrast', contrast, 'Saturation', saturation, 'Temperature', temperature,
                           'Tint', tint, 'HighlightRecovery', recovery) s AS parameter, value""",
    "hashes": f"""
        SELECT doc_id AS id, {_spark_bits([(i + 1, i) for i in range(32)])} AS d, {_spark_bits([(i, (i + 13) % 33) for i in range(32)])} AS p
        FROM (SELECT doc_id, explode(array(array({", ".join(_letter(i) for i in range(33))}))) AS c FROM {{documents}})""",
}

# the images of ``pixels``, ``proposal`` and ``dim`` as array tiles, two strips a photo; the twins read the pixel views
_AT = "y0 * 8 + j"
_STRIP = " + ".join(f"{re.sub(r'\bi\b', _AT, _channel(shift))} * {scale}" for shift, scale in ((0, 65536), (21, 256), (42, 1)))
TILES = {
    "pixels": f"""
        SELECT vec_id AS photo, y0, 0 AS x0, 4 AS rows, 8 AS cols, 8 AS h, 8 AS w, transform(sequence(0, 31), j -> {_STRIP}) AS px
        FROM (SELECT vec_id, embedding, explode(array(0, 4)) AS y0 FROM {{embeddings}})""",
    "proposal": "transform(px, c -> least(255, shiftright(c, 16) + 24) * 65536 + (c & 65280) + greatest(0, (c & 255) - 24))",
    "dim": """transform(px, (c, j) -> CAST(floor(shiftright(c, 16) / 3) AS INT) * 65536 + CAST(floor((shiftright(c, 8) & 255) / 3) AS INT) * 256
        + CASE WHEN y0 = 0 AND j = 0 THEN 255 ELSE CAST(floor((c & 255) / 3) AS INT) END)""",
}

# one generated row per text keeps the long CASE chains out of pushed-down filters
_head, _rest = VIEWS["settings_text"].split("concat(", 1)
_body, _tail = _rest.rsplit("AS settings", 1)
_SPARK_TEXT["settings_text"] = f"{_head}explode(array(concat({_body.rstrip()})) AS settings{_tail}"

_MACROS = {
    "spark": {
        "pick": r"CAST(conv(substr(md5(\1), 1, 8), 16, 10) AS BIGINT)",
        "elem": r"element_at(\1, CAST(\2 + 1 AS INT))",
        "jsonint": r"CAST(get_json_object(\1, '$.\2') AS BIGINT)",
        "each": r"explode(sequence(0, \2 - 1)) AS \1",
    },
    "twin": {
        "pick": r"CAST('0x' || substr(md5(\1), 1, 8) AS BIGINT)",
        "elem": r"(\1)[\2 + 1]",
        "jsonint": r"CAST(json_extract_string(\1, '$.\2') AS BIGINT)",
        "each": r"unnest(range(0, \2)) AS \1",
    },
}


def _expand(text: str, dialect: str) -> str:
    for name, body in _MACROS[dialect].items():
        if body.count("\\") == 1:
            text = re.sub(rf"@{name}\(([^()]*)\)", body, text)
        else:
            text = re.sub(rf"@{name}\((\w+), ((?:[^()]|\([^()]*\))*)\)", body, text)
    return text


def _needed(names) -> list[str]:
    """The views and everything they mention, in dependency order."""
    out: list[str] = []

    def visit(name: str) -> None:
        if name in out:
            return
        for other in VIEWS:
            if other != name and re.search(rf"\b{other}\b", re.sub(r"\{\w+\}", "", VIEWS[name])):
                visit(other)
        out.append(name)

    for name in names:
        visit(name)
    return out


def _tables(text: str, dialect: str, path: str = "") -> str:
    for name in BASE:
        ref = f"parquet.`{path}/{name}.parquet`" if dialect == "spark" else name
        text = text.replace("{" + name + "}", ref)
    return text


def with_views(body: str, names: list[str]) -> str:
    """Twin SQL: the needed views as CTEs in front of ``body``."""
    ctes = [f"{n} AS ({_expand(_tables(VIEWS[n], 'twin'), 'twin').strip()})" for n in _needed(names)]
    body = _expand(_tables(body, "twin"), "twin")
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[len("WITH RECURSIVE "):]
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


class View:
    """Attribute access to views and driver tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, path: str):
        sound_unions(spark)
        self.spark = spark
        self.path = str(path).rstrip("/")

    def sql(self, body: str, *names: str) -> DataFrame:
        """Run a portable SQL text over the named views."""
        texts = {n: _SPARK_TEXT.get(n, VIEWS[n]) for n in _needed(names)}
        ctes = [f"{n} AS ({_expand(_tables(t, 'spark', self.path), 'spark').strip()})" for n, t in texts.items()]
        body = _expand(_tables(body, "spark", self.path), "spark")
        return self.spark.sql(("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body)

    def tiles(self, name: str = "pixels") -> DataFrame:
        """The images of a pixel view as array tiles."""
        base = self.spark.sql(_expand(_tables(TILES["pixels"], "spark", self.path), "spark"))
        px = F.col("px") if name == "pixels" else F.expr(TILES[name])
        # one generated row computes the codes of a tile once, wherever they are read
        return base.withColumn("_px", px).select(*[c for c in base.columns if c != "px"], F.explode(F.array("_px")).alias("px"))

    @property
    def hashes(self) -> DataFrame:
        """The view ``hashes``; its SQL text walks every text 33 times."""
        docs = self.documents.select("doc_id", "text")
        return docs.mapInArrow(_letter_hashes, f"id {docs.schema['doc_id'].dataType.simpleString()}, d long, p long")

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}", name)
        if name in BASE:
            return self.spark.read.parquet(f"{self.path}/{name}.parquet")
        raise AttributeError(name)
