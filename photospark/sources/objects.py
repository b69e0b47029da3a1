"""Reading one large JSON object, such as all labels keyed by photo, in several tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photospark.contract import require

BLOCK = 1 << 20  # bytes of text that are looked through at once


def _signs(block: bytes, quoted: bool):
    """(bytes, depths, quotes): the code of every byte outside strings (0 inside), how much deeper it is after each byte, and whether their number of quotes is odd."""
    import numpy as np

    codes = np.frombuffer(block, dtype=np.uint8)
    quote = codes == ord('"')
    slash = np.flatnonzero(codes == ord("\\"))
    if len(slash):  # the byte behind an odd run of backslashes is no sign
        ends = np.flatnonzero(np.append(np.diff(slash) != 1, True))
        odd = np.diff(np.append(-1, ends)) % 2 == 1
        behind = slash[ends[odd]] + 1
        quote[behind[behind < len(codes)]] = False
    count = np.cumsum(quote, dtype=np.int64)
    outside = (count + quoted) % 2 == 0
    outer = np.where(outside & ~quote, codes, 0)
    if len(slash):
        outer[behind[behind < len(codes)]] = 0
    step = ((outer == ord("{")) | (outer == ord("["))).astype(np.int8) - ((outer == ord("}")) | (outer == ord("]"))).astype(np.int8)
    return outer, np.cumsum(step, dtype=np.int64), bool(len(count) and count[-1] % 2)


def _blocks(chunks):
    """The text of consecutive chunks in blocks of about ``BLOCK`` bytes."""
    held, size = [], 0
    for chunk in chunks:
        held.append(chunk.encode())
        size += len(held[-1])
        if size >= BLOCK:
            yield b"".join(held)
            held, size = [], 0
    if held:
        yield b"".join(held)


def _after(block: bytes, quoted: bool, depth: int) -> tuple[bool, int]:
    """Whether the text goes on inside a string behind a block, and how deep."""
    _, depths, odd = _signs(block, quoted)
    return quoted != odd, depth + int(depths[-1])


def _ends(chunks, quoted: bool) -> tuple[bool, int]:
    """Whether a run of chunks ends inside a string, and how much deeper, when it starts (not) inside one."""
    depth = 0
    for block in _blocks(chunks):
        quoted, depth = _after(block, quoted, depth)
    return quoted, depth


def _pieces(chunks, quoted: bool, depth: int):
    """(kind, text) of a split: ``whole`` entries, the ``rest`` of an entry begun earlier, the ``start`` of one that goes on."""
    import numpy as np

    text, kind = [], "rest"
    for block in _blocks(chunks):
        outer, depths, odd = _signs(block, quoted)
        level = depths + depth
        cuts = np.flatnonzero(((outer == ord("{")) & (level == 1)) | ((outer == ord(",")) & (level == 1)) | ((outer == ord("}")) & (level == 0)))
        begin = 0
        for at in cuts.tolist():
            sign = block[at:at + 1]
            if sign == b"{":
                text, kind = [], "start"
            else:
                text.append(block[begin:at])
                yield ("whole" if kind == "start" else "rest"), b"".join(text).decode()
                text, kind = [], ("start" if sign == b"," else "over")
            begin = at + 1
        text.append(block[begin:])
        quoted, depth = quoted != odd, int(level[-1])
    if kind != "over":
        yield kind, b"".join(text).decode()


def read_object(spark: SparkSession, path: str) -> DataFrame:
    """(file, entry): the texts ``"key": value`` of the outer entries of JSON files that hold one object each.

    The text reader cuts a file at ``}`` into splits of ``spark.sql.files.maxPartitionBytes``. A split can't know
    whether it starts inside a string or how deep, so a first pass sums up both cases per split, the sums (one row per split)
    are composed in file order, and a second pass cuts every split at the commas of the outer object. The two
    fragments at the ends of a split are joined to their neighbours'. An empty object gives no row; text after its end is ignored.
    """
    chunks = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value")

    def runs(batches, *columns):
        """(what stands on the rows of a split, its chunks), split by split; the rows of a split lie one behind the other."""
        from itertools import groupby

        def lines():
            for batch in batches:
                yield from zip(zip(*(batch.column(c).to_pylist() for c in columns)), batch.column("value").to_pylist())

        for key, rows in groupby(lines(), key=lambda line: line[0]):
            yield key, (value + "}" for _, value in rows)

    def sum_up(batches):
        import pyarrow as pa

        for (file, at), texts in runs(batches, "file", "at"):
            plain, inside = (False, 0), (True, 0)
            for block in _blocks(texts):
                plain, inside = _after(block, *plain), _after(block, *inside)
            yield pa.RecordBatch.from_pylist([{"file": file, "at": at, "q0": plain[0], "d0": plain[1], "q1": inside[0], "d1": inside[1]}])

    def cut(batches):
        from itertools import islice

        import pyarrow as pa

        for (file, at, quoted, depth), texts in runs(batches, "file", "at", "quoted", "depth"):
            found = enumerate(_pieces(texts, quoted, depth))
            while part := list(islice(found, 2000)):
                yield pa.RecordBatch.from_pylist([{"file": file, "at": at, "n": i, "kind": k, "text": t} for i, (k, t) in part])

    sums = chunks.select("file", "at", "value").mapInArrow(sum_up, "file string, at long, q0 boolean, d0 long, q1 boolean, d1 long")
    listed = sums.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", "q0", "d0", "q1", "d1"))).alias("splits"))
    begin = F.struct(F.array().cast("array<struct<at: bigint, quoted: boolean, depth: bigint>>").alias("done"), F.lit(False).alias("quoted"), F.lit(0).cast("bigint").alias("depth"))
    composed = F.aggregate("splits", begin, lambda s, x: F.struct(
        F.concat(s["done"], F.array(F.struct(x["at"].alias("at"), s["quoted"].alias("quoted"), s["depth"].alias("depth")))).alias("done"),
        F.when(s["quoted"], x["q1"]).otherwise(x["q0"]).alias("quoted"), (s["depth"] + F.when(s["quoted"], x["d1"]).otherwise(x["d0"])).alias("depth")))
    starts = listed.select("file", F.explode(composed["done"]).alias("_s")).select("file", "_s.*")
    # one row per split goes to the tasks that read the splits, whose order it keeps; the text is never shuffled
    pieces = chunks.join(F.broadcast(starts), ["file", "at"]).select("file", "at", "quoted", "depth", "value").mapInArrow(cut, "file string, at long, n long, kind string, text string")
    in_file = Window.partitionBy("file").orderBy("at", "n").rowsBetween(Window.unboundedPreceding, 0)
    broken = pieces.where("kind <> 'whole'").withColumn("part", F.count_if(F.col("kind") == "start").over(in_file))
    mended = broken.groupBy("file", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "n", "text"))), lambda p: p["text"]), "").alias("entry"))
    entries = pieces.where("kind = 'whole'").select("file", F.col("text").alias("entry")).unionByName(mended.select("file", "entry"))
    return entries.where(F.trim(F.translate("entry", "\r\n\t", "   ")) != "")


def read_label_object(spark: SparkSession, path: str) -> DataFrame:
    """Labels of one object keyed by photo, {photo: {expert: {parameter: value}}}, to long rows; a broken entry fails the job."""
    kind = "map<string, map<string, map<string, double>>>"
    parsed = read_object(spark, path).select(F.from_json(F.concat(F.lit("{"), "entry", F.lit("}")), kind, {"mode": "PERMISSIVE"}).alias("m"))
    sound = require(parsed, F.col("m").isNotNull() & (F.size("m") == 1), "a label entry can't be read")
    return sound.select(F.explode("m").alias("photo_id", "_e")).select("photo_id", F.explode("_e").alias("expert", "_p")).select(
        "photo_id", "expert", F.explode("_p").alias("parameter", "value"))
