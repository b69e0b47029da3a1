"""Related-photo proposals: exact Hamming and capture-time joins in a form that never expands copies.

Equal codes (or equal instants) are collapsed first. Copies are linked to one representative, and
representatives are linked to each other with the number of photos they stand for, so a group of
copies costs one row per photo instead of one row per pair while describing every pair.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from photospark.contract import require
from photospark.functions.arrays import hamming
from photospark.operators.components import connected_components
from photospark.session import cut_lineage


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def bit_runs(free: int, limit: int) -> list[int]:
    """Masks of ``limit + 1`` runs of the free bits: codes that differ in at most ``limit`` of them agree on one run."""
    places = [b for b in range(64) if free >> b & 1]
    edges = [len(places) * i // (limit + 1) for i in range(limit + 2)]
    return [sum(1 << b for b in places[edges[i]:edges[i + 1]]) for i in range(limit + 1)]


@dataclass(frozen=True)
class Path:
    """The runs on which the codes of a cell agree, and the earlier runs on which a pair must not agree to be kept here."""

    d: int = 0
    p: int = 0
    not_d: tuple[int, ...] = ()
    not_p: tuple[int, ...] = ()


def split_tree(bits: int, d: int, p: int, depth: int) -> list[list[tuple[int, Path]]]:
    """Per level (path of the level before, path): a cell is split on runs of the first hash, then of the second, in turn.

    A level after the first is left out where its runs are so short that more copies than cells would be made.
    """
    whole, paths, levels = (1 << bits) - 1, [Path()], []
    for level in range(depth):
        limit = p if level % 2 else d
        free = min(bin(whole & ~(old.p if level % 2 else old.d)).count("1") for old in paths)
        if level and 2 * (limit + 1) > 2 ** (free / (limit + 1)):
            break
        children = []
        for at, old in enumerate(paths):
            runs = bit_runs(whole & ~(old.p if level % 2 else old.d), limit)
            for i, m in enumerate(runs):
                children.append((at, Path(old.d, old.p | m, old.not_d, (*old.not_p, *runs[:i])) if level % 2 else Path(old.d | m, old.p, (*old.not_d, *runs[:i]), old.not_p)))
        levels.append(children)
        paths = [c for _, c in children]
    return levels


CELL = ["path", "kd", "kp"]


def _table(spark: SparkSession, children: list[tuple[int, Path]]) -> DataFrame:
    """The paths of a level as rows; their number depends on the limits only."""
    rows = [(old, i, _signed(c.d), _signed(c.p), [_signed(m) for m in c.not_d], [_signed(m) for m in c.not_p]) for i, (old, c) in enumerate(children)]
    return F.broadcast(spark.createDataFrame(rows, "_old int, _path int, _md long, _mp long, _not_d array<long>, _not_p array<long>"))


def _split(rows: DataFrame, children: list[tuple[int, Path]]) -> DataFrame:
    """Rows in the cells one level down: path, and the bits of both hashes on which the cell agrees."""
    below = _table(rows.sparkSession, children).drop("_not_d", "_not_p")
    kept = [c for c in rows.columns if c not in CELL]
    return rows.join(below, F.col("path") == F.col("_old")).select(
        *kept, F.col("_path").alias("path"), F.col("d").bitwiseAND(F.col("_md")).alias("kd"), F.col("p").bitwiseAND(F.col("_mp")).alias("kp"))


def _kept_here(pairs: DataFrame, children: list[tuple[int, Path]], dd: Column, pp: Column) -> DataFrame:
    """Pairs that, by their differing bits, agree on no earlier run: such a pair is found in this cell only."""
    clear = lambda masks, diff: F.forall(masks, lambda m: diff.bitwiseAND(m) != 0)
    return pairs.join(_table(pairs.sparkSession, children).drop("_md", "_mp"), F.col("path") == F.col("_path")).where(clear("_not_d", dd) & clear("_not_p", pp))


def hash_codes(hashes: DataFrame, id_col: str = "id") -> DataFrame:
    """Distinct (d, p) codes with a representative id and the number of photos."""
    return hashes.groupBy("d", "p").agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n"))


def _in_root(codes: DataFrame) -> DataFrame:
    return codes.withColumns({"path": F.lit(0), "kd": F.lit(0).cast("long"), "kp": F.lit(0).cast("long")})


def _crowded(rows: DataFrame, crowd: int) -> DataFrame:
    """Rows with ``_n``, the size of their cell where that is above ``crowd`` (else null)."""
    return rows.join(rows.groupBy(*CELL).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > crowd), CELL, "left")


#: Rows of one side of a comparison that meet in one task; a cell of the whole table is cut in ``SPREAD`` pieces at least.
PIECE, SPREAD = 4096, 16


def _whole(codes: DataFrame, first: list[tuple[int, Path]]) -> int | None:
    """The number of codes where cells of the first level don't halve the pairs to compare, so that all codes stay one cell; else None."""
    cells = _split(_in_root(codes), first).groupBy(*CELL).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    row = cells.agg(F.sum("_n").alias("rows"), F.sum(F.col("_n") * F.col("_n")).alias("pairs")).first()
    n = int((row["rows"] or 0) / len(first))
    return n if 2 * (row["pairs"] or 0) >= n * n else None


def _side(rows: DataFrame, s: str, own: str, other: str, others: Column, columns: list[str]) -> DataFrame:
    """Copies of the rows for the piece pairs of their cell, in as many tasks as the session shuffles to, however few bytes they are."""
    cell = [c for c in CELL if c in rows.columns]
    named = rows.withColumn("_other", F.explode(others)).select(*cell, F.col("_own").alias(own), F.col("_other").alias(other), *[F.col(c).alias(f"{c}_{s}") for c in columns])
    return named.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *cell, "_a", "_b").hint("merge")


def _meet(rows: DataFrame, pieces: Column, columns: list[str]) -> DataFrame:
    """Pairs of rows of a cell, each in one order. A cell is cut in ``pieces``, and every two of them meet in a task of their own."""
    own = rows.withColumn("_own", F.pmod(F.xxhash64("rep"), pieces))
    left = _side(own, "l", "_a", "_b", F.sequence(F.col("_own"), pieces - 1), columns)
    right = _side(own, "r", "_b", "_a", F.sequence(F.lit(0).cast("long"), F.col("_own")), columns)
    return left.join(right, [c for c in left.columns if c in (*CELL, "_a", "_b")]).where("_a < _b OR rep_l < rep_r")


def _pieces(n: Column, piece: int, least: int = 1) -> Column:
    """How many pieces a cell of ``n`` rows (null: few) is cut in."""
    return F.greatest(F.coalesce(F.ceil(n / piece), F.lit(1)), F.lit(least)).cast("long")


def code_pairs(codes: DataFrame, d: int = 4, p: int = 8, bits: int = 64, crowd: int = 2000, depth: int = 3, piece: int = PIECE) -> DataFrame:
    """Pairs of the given distinct codes (d, p, rep, ..) within both limits: every column twice, ``_l`` and ``_r`` with rep_l < rep_r.

    Codes within a limit agree on one of ``limit + 1`` runs of bits, so they meet in a cell (exact recall). A cell of
    more than ``crowd`` codes is split again: on runs of the second hash, then on runs of the bits of the first that are
    still free. A pair is kept under its first agreeing runs only, so no de-duplication shuffle follows. Cells that
    stay crowded at the last level are compared piece by piece. Where the first cells would be so full that
    they don't halve the work (many near pairs, short codes), all codes are one cell. Pairs are never shuffled.
    """
    names, parts, levels = codes.columns, [], split_tree(bits, d, p, depth)
    dd, pp = F.col("d_l").bitwiseXOR(F.col("d_r")), F.col("p_l").bitwiseXOR(F.col("p_r"))
    close, rows = (F.bit_count(dd) <= d) & (F.bit_count(pp) <= p), _in_root(codes)
    whole = _whole(codes, levels[0])
    if whole is not None:
        parts.append(_meet(codes, _pieces(F.lit(whole), piece, SPREAD), names).where(close))
        levels = []
    for children in levels:
        marked = _crowded(_split(rows, children), crowd)
        leaf = marked if children is levels[-1] else marked.where("_n IS NULL")
        parts.append(_kept_here(_meet(leaf, _pieces(F.col("_n"), piece), names).where(close), children, dd, pp))
        rows = marked.where("_n IS NOT NULL").drop("_n")
    turn = F.col("rep_l") < F.col("rep_r")
    either = lambda c, s, o: F.when(turn, F.col(f"{c}_{s}")).otherwise(F.col(f"{c}_{o}")).alias(f"{c}_{s}")
    return reduce(DataFrame.unionByName, [x.select(*[either(c, s, o) for s, o in ("lr", "rl") for c in names]) for x in parts])


def near_dup_pairs(hashes: DataFrame, d: int = 4, p: int = 8, bits: int = 64, crowd: int = 2000, depth: int = 3, id_col: str = "id") -> DataFrame:
    """Pairs of distinct codes within both limits: (left, right, dhash, phash, n_left, n_right), found by ``code_pairs``.

    Copies of one code: ``copy_links``; where the pairs themselves would be too many: ``near_dup_links``.
    """
    met = code_pairs(cut_lineage(hash_codes(hashes, id_col)), d, p, bits, crowd, depth)
    return met.select(F.col("rep_l").alias("left"), F.col("rep_r").alias("right"), hamming(F.col("d_l"), F.col("d_r")).alias("dhash"), hamming(F.col("p_l"), F.col("p_r")).alias("phash"),
                      F.col("n_l").alias("n_left"), F.col("n_r").alias("n_right"))


def near_dup_branches(hashes: DataFrame, branches: dict[str, tuple[int, int]], bits: int = 64, id_col: str = "id") -> DataFrame:
    """(left, right, dhash, phash, branch..): near pairs of several branches (name -> limits), with a boolean per branch that says whether it has the pair.

    ``merge_branches`` makes the same of the branches' own pairs. Here they are searched once, under the widest limits, and
    a pair's branches are read from its distances, so no pair is shuffled.
    """
    pairs = near_dup_pairs(hashes, max(d for d, _ in branches.values()), max(p for _, p in branches.values()), bits, id_col=id_col)
    held = {name: (F.col("dhash") <= d) & (F.col("phash") <= p) for name, (d, p) in branches.items()}
    return pairs.where(reduce(lambda a, b: a | b, held.values())).select("left", "right", "dhash", "phash", *[c.alias(name) for name, c in held.items()])


#: Members of a cell that every other member is held against first.
HUBS = 32


def near_dup_links(hashes: DataFrame, d: int = 4, p: int = 8, bits: int = 64, crowd: int = 2000, depth: int = 3, id_col: str = "id") -> DataFrame:
    """(left, right): a spanning forest of the codes under ``near_dup_pairs``, with one link less than codes in each component.

    With ``copy_links`` it spans all photos.
    """
    return code_links(cut_lineage(hash_codes(hashes, id_col).select("d", "p", "rep")), d, p, bits, crowd, depth)


def code_links(codes: DataFrame, d: int = 4, p: int = 8, bits: int = 64, crowd: int = 2000, depth: int = 3,
               accept: Callable[[Column, Column], Column] | None = None, piece: int = PIECE) -> DataFrame:
    """(left, right): a spanning forest of the graph of ``code_pairs``, or of those of its pairs that ``accept`` (least id, other id) takes.

    The cells are the same. In each, every code is first held against ``HUBS`` of its members; then the members outside
    the cell's largest component are compared with members of other components, and cells inside one component are
    left out. Of the links found in a round each component keeps its least one, so a dense ball of codes costs about a link per code.
    """
    roots = codes.select("rep", F.col("rep").alias("root"))
    rows, forest, levels = _in_root(codes), [], split_tree(bits, d, p, depth)
    whole = _whole(codes, levels[0])
    if whole is not None:
        levels = [None]
    taken = (lambda a, b: accept(F.least(a, b), F.greatest(a, b))) if accept else lambda a, b: F.lit(True)
    close = lambda d1, d2, p1, p2: (F.bit_count(d1.bitwiseXOR(d2)) <= d) & (F.bit_count(p1.bitwiseXOR(p2)) <= p)
    for children in levels:
        cells = cut_lineage(_crowded(_split(rows, children) if children else rows, crowd))
        last, star = children is levels[-1], True
        while True:
            placed = cells.join(roots, "rep")
            sizes = placed.groupBy(*CELL, "root").agg(F.count(F.lit(1)).alias("_c"))
            open_cells = sizes.groupBy(*CELL).agg(F.max(F.struct("_c", "root")).alias("_main"), F.sum("_c").alias("_all"), F.count(F.lit(1)).alias("_roots")).where("_roots > 1")
            live = placed.join(open_cells, CELL)
            if star:
                hubs = live.groupBy(*CELL, F.pmod(F.xxhash64("rep"), F.lit(HUBS)).alias("_hub")).agg(F.min(F.struct("rep", "d", "p", "root")).alias("_o"))
                held = live.join(hubs, CELL).where((F.col("root") != F.col("_o.root")) & close(F.col("d"), F.col("_o.d"), F.col("p"), F.col("_o.p")) & taken(F.col("rep"), F.col("_o.rep")))
                found = held.select(F.col("rep").alias("a"), F.col("_o.rep").alias("b"), F.col("root").alias("ra"), F.col("_o.root").alias("rb"))
            else:
                live = live if last else live.where("_n IS NULL")
                few, many = _pieces(F.col("_all") - F.col("_main._c"), piece), _pieces(F.col("_all"), piece, SPREAD if whole is not None else 1)
                cut = lambda own: live.withColumn("_own", F.pmod(F.xxhash64("rep"), own))
                whole_row = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
                left = _side(cut(few).where(F.col("root") != F.col("_main.root")), "l", "_a", "_b", whole_row(many), ["d", "p", "rep", "root"])
                met = left.join(_side(cut(many), "r", "_b", "_a", whole_row(few), ["d", "p", "rep", "root"]), [*CELL, "_a", "_b"])
                near = met.where(F.col("root_l") != F.col("root_r")).where(close(F.col("d_l"), F.col("d_r"), F.col("p_l"), F.col("p_r")) & taken(F.col("rep_l"), F.col("rep_r")))
                found = near.select(F.col("rep_l").alias("a"), F.col("rep_r").alias("b"), F.col("root_l").alias("ra"), F.col("root_r").alias("rb"))
            link = F.struct(F.xxhash64(F.least("a", "b"), F.greatest("a", "b")).alias("order"), F.least("a", "b").alias("left"), F.greatest("a", "b").alias("right"), F.least("ra", "rb").alias("u"), F.greatest("ra", "rb").alias("v"))
            ends = found.select(link.alias("_l"), F.explode(F.array("ra", "rb")).alias("_root"))
            chosen = cut_lineage(ends.groupBy("_root").agg(F.min("_l").alias("_l")).select("_l.left", "_l.right", "_l.u", "_l.v").distinct())
            if chosen.isEmpty():
                if not star:
                    break
                star = False
                continue
            star = False
            forest.append(chosen.select("left", "right"))
            moved = connected_components(chosen.select(F.col("u").alias("id")).union(chosen.select(F.col("v").alias("id"))).distinct(), chosen.select("u", "v"))
            roots = cut_lineage(roots.join(moved.select(F.col("id").alias("root"), F.col("group").alias("_to")), "root", "left").select("rep", F.coalesce("_to", "root").alias("root")))
        if last:
            break
        spread = cells.where("_n IS NOT NULL").join(roots, "rep")
        open_cells = spread.groupBy(*CELL).agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").select(*CELL)
        rows = cut_lineage(spread.join(open_cells, CELL, "left_semi").drop("_n", "root"))
        if rows.isEmpty():
            break
    return reduce(DataFrame.unionByName, forest) if forest else codes.select(F.col("rep").alias("left"), F.col("rep").alias("right")).limit(0)


def _with_least(df: DataFrame, keys: list[str], value: Column, salts: int = 32) -> DataFrame:
    """Add ``_m``, the least ``value`` of each class, null keys counting as equal; a class is cut by a hash of its rows, so none meets in one task."""
    cls = F.struct(*[F.col(k) for k in keys])
    cut = df.withColumns({"_v": value, "_cls": cls}).withColumn("_salt", F.pmod(F.xxhash64("_v"), F.lit(salts)))
    low = cut.groupBy("_cls", "_salt").agg(F.min("_v").alias("_m")).groupBy("_cls").agg(F.min("_m").alias("_m"), F.collect_list("_salt").alias("_salts"))
    return cut.join(low.select("_cls", "_m", F.explode("_salts").alias("_salt")), ["_cls", "_salt"]).drop("_cls", "_salt")


def copy_links(df: DataFrame, keys: list[str], id_col: str = "id") -> DataFrame:
    """One row (left = representative, right = copy) per photo that shares all keys with an earlier one."""
    return _with_least(df.select(*keys, id_col), keys, F.col(id_col)).where("_v <> _m").select(F.col("_m").alias("left"), F.col("_v").alias("right"))


def instants(ctx: DataFrame, keys: list[str], t: str = "t", id_col: str = "id") -> DataFrame:
    """Distinct capture instants per camera with a representative and a count."""
    usable = ctx.where(F.col(t).isNotNull())
    return usable.groupBy(*keys, F.unix_micros(t).alias("at")).agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n"))


def burst_pairs(ctx: DataFrame, keys: list[str], gap_seconds: float = 3.0, t: str = "t", id_col: str = "id") -> DataFrame:
    """Pairs of distinct instants of one camera at most ``gap_seconds`` apart, found through time bins."""
    joined = _later(instants(ctx, keys, t, id_col), keys, int(gap_seconds * 1_000_000), ["rep", "n"])
    return joined.select(*keys, F.col("rep_l").alias("left"), F.col("rep_r").alias("right"), ((F.col("at_r") - F.col("at_l")) / 1e6).alias("gap"),
                         F.col("n_l").alias("n_left"), F.col("n_r").alias("n_right"))


def _later(points: DataFrame, keys: list[str], gap: int, columns: list[str]) -> DataFrame:
    """Pairs of instants of one camera, the later one at most ``gap`` after the other."""
    slot = F.floor(F.col("at") / gap).cast("long")
    side = lambda s, bins: points.select(*keys, bins.alias("_bin"), *[F.col(c).alias(f"{c}_{s}") for c in ("at", *columns)])
    return side("l", F.explode(F.array(slot, slot + 1))).join(side("r", slot), [*keys, "_bin"]).where((F.col("at_l") < F.col("at_r")) & (F.col("at_r") - F.col("at_l") <= gap))


def burst_neighbors(ctx: DataFrame, keys: list[str], gap_seconds: float = 3.0, t: str = "t", id_col: str = "id", bins: int = 256) -> DataFrame:
    """Per instant: photos in the following gap and the distance to the next instant inside it.

    The ordered window runs inside time bins of ``bins`` gaps; the head of each bin is copied to the bin
    before it, so one busy camera is spread over many tasks.
    """
    gap = int(gap_seconds * 1_000_000)
    placed = _binned(instants(ctx, keys, t, id_col), gap, bins)
    w = Window.partitionBy(*keys, "_bin").orderBy("at")
    step = F.lead("at").over(w) - F.col("at")
    out = placed.withColumn("following", F.coalesce(F.sum("n").over(w.rangeBetween(1, gap)), F.lit(0))).withColumn(
        "next_gap", F.when(step <= gap, step / 1e6))
    return out.where("_own").select(*keys, "at", "rep", "n", "following", "next_gap")


def burst_links(ctx: DataFrame, keys: list[str], gap_seconds: float = 3.0, t: str = "t", id_col: str = "id", bins: int = 256) -> DataFrame:
    """(left, right) chains of consecutive instants within the gap: the same groups as all pairs, one row per instant."""
    gap = int(gap_seconds * 1_000_000)
    placed = _binned(instants(ctx, keys, t, id_col), gap, bins)
    w = Window.partitionBy(*keys, "_bin").orderBy("at")
    chained = placed.withColumn("_to", F.lead("rep").over(w)).withColumn("_step", F.lead("at").over(w) - F.col("at"))
    return chained.where(F.col("_own") & (F.col("_step") <= gap)).select(F.least("rep", "_to").alias("left"), F.greatest("rep", "_to").alias("right"))


def _binned(points: DataFrame, gap: int, bins: int) -> DataFrame:
    """Instants in time bins of ``bins`` gaps, with the head of each bin copied to the bin before it."""
    width = gap * bins
    slot = F.floor(F.col("at") / width).cast("long")
    offset = F.col("at") - slot * width
    return points.withColumn("_bin", F.explode(F.when(offset <= gap, F.array(slot, slot - 1)).otherwise(F.array(slot)))).withColumn("_own", F.col("_bin") == slot)


def merge_pairs(*parts: DataFrame) -> DataFrame:
    """Union of (left, right, dhash, phash, reason) rows, oriented and merged with their distinct reasons."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    oriented = rows.select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "dhash", "phash", "reason")
    return oriented.groupBy("left", "right").agg(
        F.min("dhash").alias("dhash"), F.min("phash").alias("phash"), F.array_sort(F.collect_set("reason")).alias("reasons"))


def with_distances(pairs: DataFrame, hashes: DataFrame, id_col: str = "id") -> DataFrame:
    """Fill the hash distances of proposed pairs (a time pair keeps its distance even when it is large)."""
    left = hashes.select(F.col(id_col).alias("left"), F.col("d").alias("_dl"), F.col("p").alias("_pl"))
    right = hashes.select(F.col(id_col).alias("right"), F.col("d").alias("_dr"), F.col("p").alias("_pr"))
    both = pairs.join(left, "left").join(right, "right")
    return both.withColumn("dhash", hamming(F.col("_dl"), F.col("_dr"))).withColumn("phash", hamming(F.col("_pl"), F.col("_pr"))).drop("_dl", "_pl", "_dr", "_pr")


VISUAL, TIMED = "visual_hash", "same_camera_capture"


def joint_classes(photos: DataFrame, keys: list[str], t: str = "t", id_col: str = "id") -> DataFrame:
    """(d, p, keys.., at, rep, n): photos with equal codes, camera and instant, which no rule can tell apart. Photos without an instant are left out."""
    timed = photos.where(F.col(t).isNotNull() & reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True)))
    return timed.groupBy("d", "p", *keys, F.unix_micros(t).alias("at")).agg(F.min(id_col).alias("rep"), F.count(F.lit(1)).alias("n"))


def both_pairs(photos: DataFrame, keys: list[str], d: int = 4, p: int = 8, bits: int = 64, gap_seconds: float = 3.0, t: str = "t", id_col: str = "id") -> DataFrame:
    """(left, right, n_left, n_right): pairs of joint classes near by hash and by time.

    They meet by camera, time bin and a run of bits on which codes within the limit agree, so a burst is compared with
    what looks alike only. A pair is kept under its first agreeing run.
    """
    kept = _later_and_near(joint_classes(photos, keys, t, id_col), keys, d, p, bits, int(gap_seconds * 1_000_000), ["rep", "n"])
    return kept.select(F.col("rep_l").alias("left"), F.col("rep_r").alias("right"), F.col("n_l").alias("n_left"), F.col("n_r").alias("n_right"))


def _later_and_near(classes: DataFrame, keys: list[str], d: int, p: int, bits: int, gap: int, columns: list[str]) -> DataFrame:
    runs, every = bit_runs((1 << bits) - 1, d), ["d", "p", "at", "rep", *[c for c in columns if c != "rep"]]
    run = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(_signed(m)).cast("long").alias("m")) for i, m in enumerate(runs)]))
    points = classes.withColumn("_c", run).select("*", F.col("_c.i").alias("_run"), F.col("d").bitwiseAND(F.col("_c.m")).alias("_key")).drop("_c")
    slot = F.floor(F.col("at") / gap).cast("long") if gap else F.col("at")
    side = lambda s, bins: points.select(*keys, bins.alias("_bin"), "_run", "_key", *[F.col(c).alias(f"{c}_{s}") for c in every])
    met = side("l", F.explode(F.array(slot, slot + 1))).join(side("r", slot), [*keys, "_bin", "_run", "_key"])
    later = F.col("at_r") - F.col("at_l")
    dd, pp = F.col("d_l").bitwiseXOR(F.col("d_r")), F.col("p_l").bitwiseXOR(F.col("p_r"))
    first = reduce(lambda rest, i: F.when(dd.bitwiseAND(F.lit(_signed(runs[i])).cast("long")) == 0, i).otherwise(rest), range(len(runs) - 1, -1, -1), F.lit(None).cast("int"))
    return met.where(((later > 0) & (later <= gap) | (later == 0) & (F.col("rep_l") < F.col("rep_r"))) & (F.bit_count(dd) <= d) & (F.bit_count(pp) <= p) & (F.col("_run") == first))


def _known(keys: list[str], t: str) -> Column:
    return reduce(lambda x, k: x & F.col(k).isNotNull(), keys, F.col(t).isNotNull())


def _flagged(photos: DataFrame, keys: list[str], t: str, id_col: str) -> tuple[DataFrame, Column]:
    """Photos (id, d, p, keys.., t) with ``cr``, ``mr`` and ``jr``: whether one is the least of its code, of its camera and instant, of both; and all that as a struct."""
    rows = photos.select(F.col(id_col).alias("id"), "d", "p", *keys, F.col(t).alias("t"))
    for flag, cls in (("cr", ["d", "p"]), ("mr", [*keys, "t"]), ("jr", ["d", "p", *keys, "t"])):
        known = F.lit(True) if flag == "cr" else _known(keys, "t")
        rows = _with_least(rows, cls, F.col("id")).withColumn(flag, known & (F.col("id") == F.col("_m"))).drop("_v", "_m")
    return cut_lineage(rows), F.struct("id", "d", "p", *keys, "t", "cr", "mr", "jr")


def _sources(photos: DataFrame, keys: list[str], d: int, p: int, bits: int, gap: int, t: str, id_col: str):
    """The proposals by their source: ((name, pairs (a, b) of structs, found here: Column) ..), the codes' photos, and the rules on a row.

    Whether a pair is proposed by a source is read from its two photos, so a pair of several sources is kept by the first of them and nothing is merged.
    """
    rows, one = _flagged(photos, keys, t, id_col)
    timed = rows.where(_known(keys, "t"))
    at = lambda s: F.unix_micros(F.col(f"{s}.t"))
    looks = (hamming(F.col("a.d"), F.col("b.d")) <= d) & (hamming(F.col("a.p"), F.col("b.p")) <= p)
    alike = reduce(lambda x, k: x & (F.col(f"a.{k}") == F.col(f"b.{k}")), keys, F.lit(True))
    near, now = F.coalesce(alike & (F.abs(at("a") - at("b")) <= gap), F.lit(False)), F.coalesce(alike & (at("a") == at("b")), F.lit(False))
    code = (F.col("a.d") == F.col("b.d")) & (F.col("a.p") == F.col("b.p"))
    every = lambda flag: F.col(f"a.{flag}") & F.col(f"b.{flag}")
    rules = [every("cr") & ~code & looks, F.col("a.cr") & code, F.col("a.mr") & now, F.col("a.jr") & code & now, every("mr") & ~now & near, every("jr") & ~(code & now) & looks & near]
    copies = lambda known, cls: _with_least(known, cls, one).where("_v.id <> _m.id").select(F.col("_m").alias("a"), F.col("_v").alias("b"))
    instant = timed.groupBy(*keys, F.unix_micros("t").alias("at")).agg(F.min(one).alias("one"))
    joint = timed.groupBy("d", "p", *keys, F.unix_micros("t").alias("at")).agg(F.min(one).alias("one"))
    codes = cut_lineage(rows.where("cr").groupBy("d", "p").agg(F.min(one).alias("one")).withColumn("rep", F.col("one.id")))
    turned = lambda met: met.select(F.when(F.col("one_l.id") < F.col("one_r.id"), F.col("one_l")).otherwise(F.col("one_r")).alias("a"),
                                    F.when(F.col("one_l.id") < F.col("one_r.id"), F.col("one_r")).otherwise(F.col("one_l")).alias("b"))
    found = {
        "codes": lambda: code_pairs(codes, d, p, bits).select(F.col("one_l").alias("a"), F.col("one_r").alias("b")), "copies": lambda: copies(rows, ["d", "p"]), "instants": lambda: copies(timed, [*keys, "t"]),
        "joint": lambda: copies(timed, ["d", "p", *keys, "t"]), "bursts": lambda: turned(_later(instant, keys, gap, ["one"])),
        "both": lambda: turned(_later_and_near(joint.withColumn("rep", F.col("one.id")), keys, d, p, bits, gap, ["one"])),
    }
    first = {name: reduce(lambda x, r: x & ~r, rules[:i], F.lit(True)) for i, name in enumerate(found)}
    return found, first, codes, looks, near


def related_pairs(photos: DataFrame, keys: list[str], d: int = 4, p: int = 8, bits: int = 64, gap_seconds: float = 3.0, t: str = "t", id_col: str = "id") -> DataFrame:
    """(left, right, dhash, phash, reasons): proposals by hash and by time as one row per pair of photos with every reason that holds.

    ``photos``: (id, d, p, keys.., t), ids unique, t and keys null where unknown. Classes of equal codes, of equal camera and
    instant, and of both at once are mapped to their least photo before anything is compared: class pairs and links
    of the copies to that photo describe all pairs of photos without expanding copies, and pairs that are near in both
    ways are rows of their own. Photos travel with their class, so reasons and distances are read from the two photos of a row, and pairs are never shuffled.
    """
    found, first, _, looks, near = _sources(photos, keys, d, p, bits, int(gap_seconds * 1_000_000), t, id_col)
    rows = reduce(DataFrame.unionByName, [make().where(first[name]) for name, make in found.items()])
    reasons = F.when(near & looks, F.array(F.lit(TIMED), F.lit(VISUAL))).when(near, F.array(F.lit(TIMED))).otherwise(F.array(F.lit(VISUAL)))
    return rows.select(F.col("a.id").alias("left"), F.col("b.id").alias("right"), hamming(F.col("a.d"), F.col("b.d")).alias("dhash"), hamming(F.col("a.p"), F.col("b.p")).alias("phash"), reasons.alias("reasons"))


def related_links(photos: DataFrame, keys: list[str], accept: Callable[[Column, Column], Column], d: int = 4, p: int = 8, bits: int = 64, gap_seconds: float = 3.0,
                  t: str = "t", id_col: str = "id") -> DataFrame:
    """(u, v): links with the same groups as those ``related_pairs`` whose (left, right) ``accept`` takes.

    The pairs of codes, as many as the square of the codes where looks are dense, are replaced by a spanning forest of the accepted ones.
    """
    found, _, codes, _, _ = _sources(photos, keys, d, p, bits, int(gap_seconds * 1_000_000), t, id_col)
    rest = [make().select(F.col("a.id").alias("u"), F.col("b.id").alias("v")).where(accept(F.col("u"), F.col("v"))) for name, make in found.items() if name != "codes"]
    return reduce(DataFrame.unionByName, rest, code_links(codes.select("d", "p", "rep"), d, p, bits, accept=accept).toDF("u", "v"))


def related_counts(photos: DataFrame, keys: list[str], d: int = 4, p: int = 8, bits: int = 64, gap_seconds: float = 3.0, t: str = "t", id_col: str = "id") -> DataFrame:
    """One row (visual_only, timed_only, both): how many pairs of photos each set of reasons holds for, from the sizes of the classes."""
    photos = cut_lineage(photos.select(F.col(id_col).alias("id"), "d", "p", *keys, F.col(t).alias("t")))
    across = lambda pairs: pairs.agg(F.coalesce(F.sum(F.col("n_left") * F.col("n_right")), F.lit(0)).cast("long").alias("n")).scalar()
    inside = lambda classes: classes.agg(F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("long").alias("n")).scalar()
    known = photos.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys], F.lit(True)))
    visual = across(near_dup_pairs(photos, d, p, bits)) + inside(hash_codes(photos))
    timed = across(burst_pairs(known, keys, gap_seconds)) + inside(instants(known, keys))
    both = across(both_pairs(photos, keys, d, p, bits, gap_seconds)) + inside(joint_classes(photos, keys))
    return photos.sparkSession.range(1).select((visual - both).alias("visual_only"), (timed - both).alias("timed_only"), both.alias("both"))


def merge_branches(pairs: DataFrame) -> DataFrame:
    """Rows (branch, left, right, dhash, phash) to one row per pair with a branch -> scores map."""
    entry = F.struct(F.col("branch"), F.struct("dhash", "phash"))
    return pairs.groupBy("left", "right").agg(F.map_from_entries(F.array_sort(F.collect_set(entry))).alias("matches"))


def reviewed(pairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Pairs with their merge/reject decision; a pair without one fails the job."""
    joined = pairs.join(decisions.select("left", "right", "decision"), ["left", "right"], "left")
    return require(joined, F.col("decision").isin("merge", "reject"), "candidate pair without a merge/reject decision")


def reviewed_by(pairs: DataFrame, rule: Column) -> DataFrame:
    """``reviewed`` where a rule on the pair's columns decides in place of a table: nothing is joined."""
    return require(pairs.withColumn("decision", rule), F.col("decision").isin("merge", "reject"), "candidate pair without a merge/reject decision")


def accepted_edges(pairs: DataFrame) -> DataFrame:
    """Edges of merged pairs."""
    return pairs.where(F.col("decision") == "merge").select(F.col("left").alias("u"), F.col("right").alias("v"))
