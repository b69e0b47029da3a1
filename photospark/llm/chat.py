"""Chat formatting with Spark expressions only: sorted turns, merged runs of one role, reversible escapes, loss spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ESCAPE = "␛"
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[NEXT]")
OPEN, HEAD, NEXT, CLOSE = "<s>[ROLE]", "[/ROLE]", "[NEXT]", "</s>\n"


def escape(text: Column) -> Column:
    """Replace the escape sign and then every control string by the sign and a digit."""
    out = F.replace(text, F.lit(ESCAPE), F.lit(f"{ESCAPE}0"))
    for k, control in enumerate(CONTROLS, 1):
        out = F.replace(out, F.lit(control), F.lit(f"{ESCAPE}{k}"))
    return out


def unescape(text: Column) -> Column:
    """Undo ``escape``; the sign itself comes last, so what it yields is not read again."""
    for k, control in enumerate(CONTROLS, 1):
        text = F.replace(text, F.lit(f"{ESCAPE}{k}"), F.lit(control))
    return F.replace(text, F.lit(f"{ESCAPE}0"), F.lit(ESCAPE))


def format_conversations(rows: DataFrame, learn: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): one text per conversation and the spans (start, length) under the loss mask.

    Turns are sorted structs; neighbours of one role share a header and are divided by a mark, so the rows can be
    read back. Ties of ``turn`` follow role and text; repeated rows stay; a null turn comes first; null roles and
    texts are empty; rows without conv_id form one conversation; other columns are ignored; no rows give no rows.
    A conversation is one output text, so it is the one group that is gathered.
    """
    turns = rows.select(
        "conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    gathered = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    empty = F.array().cast("array<struct<role:string,texts:array<string>>>")

    def add(acc: Column, t: Column) -> Column:
        last = F.get(acc, F.size(acc) - 1)
        same = (F.size(acc) > 0) & (last["role"] == t["role"])
        body = escape(t["text"])
        grown = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(body)).alias("texts"))
        fresh = F.struct(t["role"].alias("role"), F.array(body).alias("texts"))
        return F.when(same, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(fresh)))

    runs = F.aggregate("ts", empty, add)
    pieces = F.flatten(F.transform(runs, lambda r: F.concat(
        F.array(_piece(F.concat(F.lit(OPEN), escape(r["role"]), F.lit(HEAD)), F.lit(False))),
        F.flatten(F.transform(r["texts"], lambda x, i: F.array(
            _piece(F.when(i > 0, F.lit(NEXT)).otherwise(F.lit("")), F.lit(False)), _piece(x, r["role"] == F.lit(learn))))),
        F.array(_piece(F.lit(CLOSE), F.lit(False))))))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def span(acc: Column, p: Column) -> Column:
        size = F.length(p["s"]).cast("long")
        one = F.array(F.struct(acc["at"].alias("start"), size.alias("length")))
        return F.struct((acc["at"] + size).alias("at"), F.when(p["loss"], F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"))

    return gathered.select("conv_id", pieces.alias("ps")).select(
        "conv_id", F.concat_ws("", F.transform("ps", lambda p: p["s"])).alias("formatted"), F.aggregate("ps", start, span, lambda a: a["spans"]).alias("loss_spans"))


def _piece(text: Column, loss: Column) -> Column:
    return F.struct(text.alias("s"), loss.alias("loss"))


def read_back(formatted: Column) -> Column:
    """The turns (role, text) in a formatted conversation, unescaped."""
    blocks = F.filter(F.split(formatted, r"</s>\n"), lambda b: b != "")

    def turns(block: Column) -> Column:
        head = F.split(F.substring(block, len(OPEN) + 1, 2**31 - 1), r"\[/ROLE\]", 2)
        role = unescape(F.get(head, F.lit(0)))
        return F.transform(F.split(F.get(head, F.lit(1)), r"\[NEXT\]"), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))


def under_mask(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped and joined."""
    return F.concat_ws("", F.transform(spans, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))))


def digest(out: DataFrame) -> DataFrame:
    """Figures and hashes read back from formatted conversations."""
    parts = out.select("conv_id", "formatted", read_back(F.col("formatted")).alias("ts"), under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    told = F.concat_ws("", F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return parts.select(
        "conv_id", F.size("ts").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
