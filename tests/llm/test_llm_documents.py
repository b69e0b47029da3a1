"""Document operators against plain versions, with nulls, empty and repeated rows, ties, clashing columns and no rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from photospark.llm import decontaminate, language, lines, near, packing, quality, resharding, toxicity
from photospark.llm import queries as Q
from photospark.llm.stage import Stage, maybe_in, with_group_min

ROOT = "/root/testdata"
FORM = "doc_id long, text string, lang string, n int, node string, key string, leaks int, dropped int, n_lines int, kept string, p int"
ODD = ["", None, " \t ", "one", "one two three", "\n\n", "ünï çødé " * 3]


def table(spark, texts, lang=None):
    return spark.createDataFrame([(i if i is None or i >= 0 else None, t, lang, 1, "x", "y", 2, 3, 4, "z", 5) for i, t in texts], FORM)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.read.parquet(f"{ROOT}/sf0.001/documents.parquet")
    return docs, {r["doc_id"]: r["text"] for r in docs.collect()}


def test_bitmap_and_salted_minimum(spark):
    ids = spark.range(0, 1000, 7)
    got = {r["id"] for r in spark.range(1000).where(maybe_in(ids, "id", F.col("id"))).collect()}
    assert set(range(0, 1000, 7)) <= got and len(got) < 160
    df = spark.range(500).select(F.when(F.col("id") < 400, 0).otherwise(F.col("id")).alias("u"), (1000 - F.col("id")).alias("v"))
    assert {(r["u"], r["v"]): r["m"] for r in with_group_min(df, ["u"], "v", "m").collect()} == {(r["u"], r["v"]): 601 if r["u"] == 0 else r["v"] for r in df.collect()}


def test_tiling_equals_the_plain_one():
    rng = random.Random(5)
    for _ in range(60):
        doc, item = [rng.randrange(4) for _ in range(rng.randrange(40))], [rng.randrange(4) for _ in range(rng.randrange(1, 16))]
        got, want = decontaminate.tile(doc, item, 3), brute.tiles(doc, item, 3)
        assert sorted(got) == sorted(want) or sum(t[2] for t in got) >= 0.8 * sum(t[2] for t in want)
        assert all(doc[d:d + n] == item[i:i + n] for d, i, n in got)
        assert len({d + k for d, _, n in got for k in range(n)}) == sum(t[2] for t in got) == len({i + k for _, i, n in got for k in range(n)})


def test_reordered_passages_are_leaks(spark):
    rng = random.Random(6)
    a, b, c = prose(rng, 12), prose(rng, 12), prose(rng, 12)
    bench = spark.createDataFrame([(1, f"{a} {b} {c}", 0), (2, "tiny one", 0), (3, None, 0), (None, a, 0), (5, "...", 0)], "item_id long, text string, doc_id int")
    texts = [(1, f"{prose(rng, 30)}. {c.upper()}, {a} {prose(rng, 9)} {b}!"), (2, f"{a} {prose(rng, 60)}"), (3, "so a tiny, one!"), (4, "tiny two one"), (3, "so a tiny, one!"), (-1, c + " " + b), (7, None), (8, "")]
    got = sorted((r["doc_id"] or 0, list(r["item_ids"]), r["kept"]) for r in decontaminate.judge(table(spark, texts), bench).collect())
    assert got == [(0, [1], False), (1, [1], False), (2, [], True), (3, [2], False), (3, [2], False), (4, [], True), (7, [], True), (8, [], True)]
    one = decontaminate.find_leaks(table(spark, texts), bench, block=1)
    assert sorted((r["doc_id"] or 0, [x["item_id"] for x in r["leaks"]]) for r in one.collect()) == [(i, x) for i, x, _ in got]
    assert "node" in one.columns and decontaminate.judge(table(spark, []), bench).count() == 0
    assert decontaminate.judge(table(spark, texts), bench.where("item_id > 9")).where("kept").count() == len(texts)


def test_decontamination_query(spark, small):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{ROOT}/sf0.001/benchmark.parquet").collect()]
    got = {r["doc_id"]: sorted(r["item_ids"]) for r in Q.op1_string_tiling(spark, f"{ROOT}/sf0.001").collect()}
    seeds = decontaminate.Seeds(items)
    for d, t in small[1].items():
        shared = [items[k] for k in seeds.shared(decontaminate.tokens(t))]
        assert got[d] == brute.leaks(t[:20_000], shared) if shared else not got[d]


def test_rule_statistics(spark, small):
    rng = random.Random(7)
    texts = [*ODD, "a b c a b c x", "l1\nl1\n\nl1 \n l1\nl1", "#%&|<>*$ #", "q\r\nq\r\nq", *[prose(rng, 80, 6) for _ in range(5)], *list(small[1].values())[:60]]
    stats = quality.statistics_of(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert tuple(int(stats[c][i]) for c in quality.COUNTS) == brute.rule_counts(t), repr(t[:80] if t else t)


def test_forest_finds_the_odd_ones(spark):
    rng = random.Random(8)
    good = [(i, prose(rng, rng.randrange(60, 200))) for i in range(300)]
    bad = [(i, " | ".join(prose(rng, 80).split())) for i in range(300, 330)]
    docs = table(spark, good + bad + [(900 + k, t) for k, t in enumerate(ODD)] + [good[0], (-1, good[1][1])])
    labels = spark.createDataFrame([(i, 1) for i, _ in good[:200]] + [(i, 0) for i, _ in bad[:20]], "doc_id long, quality int")
    rows = quality.judge(docs, labels, Stage(spark, "t")).collect()
    kept = [(r["doc_id"], r["kept"]) for r in rows]
    assert len(rows) == docs.count() and all(k == (i is None or i < 300) for i, k in kept)
    assert all(r["base_failed"] for r in rows if (r["doc_id"] or 0) >= 900)
    assert quality.judge(docs, labels.where("doc_id < 0"), Stage(spark, "t")).where("NOT base_failed AND NOT kept").count() == 0
    assert quality.judge(table(spark, []), labels, Stage(spark, "t")).count() == 0


def test_path_lengths_by_hand():
    rows = np.array([[0.0], [0.0], [0.0], [9.0]])
    trees = [quality.grow_tree(rows, s) for s in range(50)]
    path = quality.path_lengths(rows, trees)
    assert path[3] == 1.0 and abs(path[0] - (1 + quality._average_path(3))) < 1e-12


def test_near_duplicates(spark, small):
    rng = random.Random(9)
    base = prose(rng, 200, 5000).split()
    copies = []
    for k in range(40):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"v{k}"
        copies.append((2000 + k, " ".join(w)))
    stub = "these nine words open a good many short texts"
    shorts = [(3000 + k, f"{stub} {prose(rng, rng.randrange(1, 9), 3)}") for k in range(120)]
    rows = list(small[1].items())[:120] + copies + shorts + [(4000 + k, t) for k, t in enumerate(ODD)] + [(4100, "ONE two  THREE"), (4101, base[0])]
    want, sizes = brute.near_components(rows)
    got = near.near_duplicates(table(spark, rows), Stage(spark, "t")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got} == {d: (sizes[d], want[d], want[d] == d) for d in want}


def test_near_duplicates_of_odd_tables(spark):
    assert near.near_duplicates(table(spark, []), Stage(spark, "t")).count() == 0
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "quite another text it is"), (2, "quite another text it is"), (-1, "a b c d e f"), (3, None)]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in near.near_duplicates(table(spark, rows), Stage(spark, "t")).collect())
    assert got == [(0, 0, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True)]


def test_signature_is_circulant():
    first, second = near.permutations()
    some = np.random.Generator(np.random.PCG64(1)).integers(0, 2**63, 50, dtype=np.uint64)
    spots = first[(some >> np.uint64(44)).astype(np.int64)].astype(np.int64)
    want = [min(second[(s + k) % (1 << near.BITS)] for s in spots) for k in range(near.SKETCH)]
    assert near.signature(some).tolist() == want and sorted(first) == list(range(1 << near.BITS))


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_vector_best_fit(rule):
    rng = random.Random(10)
    counts = {n: rng.randrange(1, 40) for n in rng.sample(range(1, 51), 30)} | {1: 500}
    runs = packing.best_fit(counts, 64, 12, 2550, rule)
    bins, seen = {}, {n: set() for n in counts}
    for n, lo, hi, copies, seq, offset in runs:
        for r in range(lo, hi):
            assert r not in seen[n]
            seen[n].add(r)
            bins.setdefault(seq + (r - lo) // copies, []).append((offset + (r - lo) % copies * n, n))
    assert all(seen[n] == set(range(c)) for n, c in counts.items()) and sorted(bins) == list(range(len(bins)))
    for items in bins.values():
        at = 0
        for offset, n in sorted(items):
            assert offset == at
            at += n
        assert at <= 64 and len(items) <= 12 and sum(n * n for _, n in items) <= 2550
    with pytest.raises(ValueError):
        packing.best_fit({65: 1}, 64)


def test_packing_round_trip(spark, small):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(Q.TOKENIZER[0])
    texts = [*small[1].items(), *[(5000 + k, t) for k, t in enumerate([*ODD, "a\n\nb  c \n d's\t\tx", "\x1c a\x85 b  ", "<|endoftext|> hi", "x" * 5000, "y" * 30_000 + " " * 30_000])], (5000, ""), (-1, "no id")]
    out = packing.pack(table(spark, texts), Q.TOKENIZER, Stage(spark, "t")).toPandas()
    by = {d: x.sort_values("piece") for d, x in out[out.doc_id != 5000].groupby("doc_id", dropna=False)}
    for d, t in texts:
        if d == 5000:
            continue
        ids = [*model.encode(t or "", add_special_tokens=False).ids, 2]
        own = by[d] if d >= 0 else out[out.doc_id.isna()]
        assert list(own.length[1:]) == [1024] * (len(own) - 1) and own.length.sum() == len(ids)
        assert [zlib.crc32(np.array(ids[s:s + n], "<u4").tobytes()) for s, n in zip(own.start, own.length)] == list(own.ids_crc32)
    assert len(out[out.doc_id == 5000]) == 2
    for _, x in out.groupby("sequence_id"):
        x = x.sort_values("offset")
        assert x.length.sum() <= 1024 and list(x.offset) == [0, *x.length.cumsum()[:-1]]
    assert out.sequence_id.nunique() <= -(-out.length.sum() // 1024) + 2
    assert packing.pack(table(spark, []), Q.TOKENIZER, Stage(spark, "t")).count() == 0


def test_transfers_are_cheapest():
    rng = random.Random(11)
    for _ in range(30):
        olds, shards = rng.randrange(1, 5), rng.randrange(1, 4)
        sizes = [sorted(rng.randrange(1, 50) for _ in range(rng.randrange(0, 6))) for _ in range(olds)]
        total = sum(map(len, sizes))
        low, extra = divmod(total, shards)
        marginal = [float(s[len(s) - low - 1]) if i < shards and len(s) > low else 0.0 for i, s in enumerate(sizes)]
        flows = resharding.transfers([len(s) for s in sizes], shards, marginal)
        into = [sum(n for _, j, n in flows if j == k) for k in range(shards)]
        assert sorted(into) == [low] * (shards - extra) + [low + 1] * extra
        stay = {i: n for i, j, n in flows if i == j}
        cost = sum(sum(s[:len(s) - stay.get(i, 0)]) for i, s in enumerate(sizes))
        import itertools
        best = min(sum(sum(s[:max(0, len(s) - (low + (i in grant)))]) if i < shards else sum(s) for i, s in enumerate(sizes)) for grant in itertools.combinations(range(shards), extra))
        assert cost == best


def test_resharding(spark, tmp_path):
    rng = random.Random(12)
    rows = [(i, None if i % 50 == 0 else "é" * rng.randrange(1, 40), "a" if i < 300 else rng.choice("bcd")) for i in range(400)] + [(7, "twice", None), (7, "twice", None), (None, "x", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = resharding.reshard(docs, F.col("source"), Stage(spark, "t"), 6).toPandas()
    assert len(out) == len(rows) and set(out["shard"]) == set(range(6))
    counts = out.groupby("shard").size()
    assert counts.max() - counts.min() <= 1 and all(sorted(x) == list(range(len(x))) for _, x in out.groupby("shard").slot)
    want = sorted((len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert sorted(zip(out["size"], out.text_crc32)) == want
    for old, x in out.groupby("old_shard"):
        gone, stay = x[x["shard"] != old]["size"], x[x["shard"] == old]["size"]
        assert not len(gone) or not len(stay) or gone.max() <= stay.min()
    assert resharding.reshard(docs.where("doc_id < 0"), F.col("source"), Stage(spark, "t"), 6).count() == 0
    unique = docs.where("doc_id IS NOT NULL AND doc_id <> 7")
    placed = resharding.reshard(unique, F.col("source"), Stage(spark, "t"), 6)
    touched = resharding.rewrite(unique, placed, str(tmp_path / "shards"))
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert back.count() == placed.where(F.col("shard").isin(touched)).count() and back.columns[:3] == ["doc_id", "text", "source"]


def test_resharded_files_keep_every_row(spark):
    rng = random.Random(19)
    rows = [(i, "é" * rng.randrange(1, 40), rng.choice("aaab")) for i in range(200)] + [(7, "twice", None)] * 2 + [(7, "other", "b"), (None, "x", "b"), (None, "x", "b"), (None, None, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    stage = Stage(spark, "t")
    out = resharding.reshard_files(docs, F.col("source"), stage, 4)
    files = spark.read.parquet(f"{stage.root}/files")
    key = lambda i, t: (i is None, i or 0, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    got = out.collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"], r["text_crc32"]) for r in got) == sorted(key(i, t) for i, t, _ in rows)
    touched = {r["shard"] for r in files.select("shard").distinct().collect()}
    assert touched and files.count() == sum(r["shard"] in touched for r in got) and files.select("row").distinct().count() == files.count()
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got))) for s in range(4))
    assert resharding.reshard_files(docs.where("doc_id < 0"), F.col("source"), Stage(spark, "t"), 4).count() == 0


def test_clause_grammar():
    g = toxicity.Grammar(["moron"], ["lowei"])
    assert g.patterns("What a MORON. Fine day") == {"insult": 1}
    assert g.patterns("you are a moron, I will hurt you") == {"insult at target": 1, "threat": 1, "threat at target": 1}
    assert g.patterns("he is not a moron") == {"negated insult": 1}
    assert g.patterns("they said he was a moron; loweischaft") == {"reported insult": 1, "insult": 1}
    assert g.patterns("not one of them was ever seen near the big old house moron") == {"insult": 1}
    assert g.patterns("") == {} and g.patterns("oxymoronic") == {}
    w = dict.fromkeys(toxicity.PATTERNS, 0.5)
    assert toxicity.score_of({}, w, 0.01) == pytest.approx(0.01) and toxicity.score_of({"insult": 2}, w, 0.0) == 0.75


def test_toxicity_learns(spark):
    rng = random.Random(13)
    insults, stem = ["grobian", "flegel"], "tolpat"
    clean = [(i, prose(rng, 60)) for i in range(300)]
    toxic = [(400 + i, f"{prose(rng, 20)} {rng.choice([*insults, stem + rng.choice('abcdefgh') * 3])} {prose(rng, 20)}") for i in range(150)]
    taught = spark.createDataFrame([(i, t, int(i >= 400)) for i, t in clean[:200] + toxic[:100]], "doc_id long, text string, toxic int")
    model = toxicity.fit(taught)
    assert "grobian" in model[0].cues and any(stem.startswith(s) or s.startswith(stem) for s in model[0].stems)
    docs = table(spark, clean[200:] + toxic[100:] + [(900 + k, t) for k, t in enumerate(ODD)] + [toxic[100], (-1, "grobian")])
    got = [(r["doc_id"], r["score"], r["predicted"]) for r in toxicity.score(docs, *model).collect()]
    assert len(got) == docs.count() and all(0 <= s <= 1 and p == (i is None or 400 <= i < 900) for i, s, p in got)
    none = toxicity.fit(taught.where("doc_id < 0"))
    assert toxicity.score(docs, *none).where("predicted = 1").count() == 0 and toxicity.score(table(spark, []), *model).count() == 0


def codes(names):
    out = {}
    for row, _, _, sim, _, _ in lines.hashes_of(pa.array(names, pa.string())):
        out.update({names[r]: int(s) & (2**64 - 1) for r, s in zip(row, sim)})
    return out


def test_simhash_by_hand():
    from photospark.llm import kernels as K

    text = "Alpha beta, beta 12 gamma"
    words = brute.plain_line(text).split()
    h = [int(K.Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())])).hash[0]).to_bytes(8, "little") for w in words]
    bits = np.array([np.unpackbits(np.frombuffer(x, np.uint8)) for x in h]).sum(0) * 2 > len(words)
    assert codes([text])[text] == int.from_bytes(np.packbits(bits).tobytes(), "little")


def test_edit_distance():
    rng = random.Random(14)
    for _ in range(300):
        a, b = ("".join(rng.choices("abcé", k=rng.randrange(14))) for _ in range(2))
        assert lines.edits(a, b) == brute.distance(a, b)


def test_line_dedup(spark, small):
    rng = random.Random(15)
    long = prose(rng, 90, 9000)
    near_lines = [long.replace(f" {w} ", f" {w}x ", 1) for w in rng.sample(long.split()[1:-1], 25)]
    rows = [(d, t[:6000]) for d, t in list(small[1].items())[:60]] + [(600 + k, f"own line {k}\n{x}\r\n\n{long.upper()}!") for k, x in enumerate(near_lines)]
    rows += [(700 + k, t) for k, t in enumerate(ODD)] + [(800, "a b c d 12\nA, b c d 77\nshort"), (801, "a b c d 90")]
    out = lines.dedup_lines(table(spark, rows), Stage(spark, "t"))
    got = {r["doc_id"]: (list(r["dropped"]), r["text"], r["n_lines"]) for r in out.collect()}
    want = brute.repeated_lines(rows, lines.edits)
    for d, t in rows:
        gone = want.get(d, [])
        left = None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone)
        assert got[d] == (gone, left, 0 if t is None else len(t.split("\n")))
    assert out.columns[:2] == ["doc_id", "text"] and "node" in out.columns
    assert lines.dedup_lines(table(spark, []), Stage(spark, "t")).count() == 0
    twice = [(1, "the same five words here"), (1, "the same five words here"), (-1, "the same five words here"), (1, "another text\nthe same five words here")]
    texts = sorted((r["doc_id"] or 0, r["text"]) for r in lines.dedup_lines(table(spark, twice), Stage(spark, "t")).collect())
    assert texts == [(0, "the same five words here"), (1, ""), (1, ""), (1, "another text")]


def test_language(spark):
    docs = Q.op10_hyper_language(spark, f"{ROOT}/sf0.01")
    truth = spark.read.parquet(f"{ROOT}/sf0.01/documents.parquet").select("doc_id", "lang")
    right = docs.join(truth, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.98
    names, protos = language.fit_prototypes(table(spark, [(1, "der die das und"), (2, "der und das nicht")], "de").unionByName(table(spark, [(3, "the and of that"), (-1, "the of and this")], "en")))
    assert names == ["de", "en"]
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(table(spark, [(1, "und das"), (2, "of the"), (3, None), (4, ""), (5, "12 !?"), (6, "the " * 90_000)]), names, protos).collect()}
    assert got == {1: "de", 2: "en", 3: "und", 4: "und", 5: "und", 6: "en"}
    assert language.predict(table(spark, []), names, protos).count() == 0 and language.fit_prototypes(table(spark, []))[0] == []


def test_binding_and_bundling():
    grams = np.array([[97, 98, 99]], np.uint32)
    want = np.roll(language.letter_vector(97), 2) * np.roll(language.letter_vector(98), 1) * language.letter_vector(99)
    assert (language.gram_vectors(grams)[0] == want).all()
    v, known = language.bundles(["ab"])
    codes_ = [0, 97, 98, 0]
    total = sum(language.gram_vectors(np.array([codes_[i:i + 3]], np.uint32))[0].astype(float) for i in range(2))
    assert known[0] and np.allclose(v[0], total / np.linalg.norm(total), atol=1e-5)


def edited(rng, text, n):
    for _ in range(n):
        k = rng.randrange(1, len(text) - 1)
        text = text[:k] + rng.choice(["", "q", "q" + text[k]]) + text[k + 1:]
    return text


def near_copies(rng, sizes, n):
    """Texts 2k and 2k + 1 are a line and its copy with edits; the k whose two lines are similar."""
    texts, alike = [], []
    for k in range(n):
        line = " ".join("".join(rng.choices("abcdefghijklm", k=rng.randrange(3, 9))) for _ in range(rng.choice(sizes)))
        other = edited(rng, line, max(1, len(line) // rng.choice([12, 25, 50])))
        a, b = lines.plain_lines(line)[0], lines.plain_lines(other)[0]
        if a != b and lines.similar(a, b):
            alike.append(k)
        texts += [(2 * k, line), (2 * k + 1, other)]
    return texts, alike


def test_whole_line_search(spark):
    texts, alike = near_copies(random.Random(17), [8, 10, 20, 40], 300)
    out = {r["doc_id"]: list(r["dropped"]) for r in lines.dedup_lines(table(spark, texts), Stage(spark, "t")).collect()}
    lost = [k for k in alike if out[2 * k + 1] != [0]]
    assert len(alike) > 200 and len(lost) <= len(alike) // 50 and all(len(texts[2 * k][1]) >= lines.SHORT for k in lost)
    assert all(out[2 * k] == [] for k in range(300))


def test_whole_line_search_takes_short_lines(spark):
    texts, alike = near_copies(random.Random(18), [2, 3, 4], 200)
    odd = [(1000, "and\nx y\n漢字かなまじり文"), (1001, "AND!\nx  y\n\n漢字かなまじり文"), (1002, "and"), (1003, ""), (1004, None), (1005, "...")]
    out = {r["doc_id"]: list(r["dropped"]) for r in lines.dedup_lines(table(spark, texts + odd), Stage(spark, "t")).collect()}
    assert [out[d] for d, _ in odd] == [[], [0, 1, 3], [0], [], [], []]
    assert len(alike) > 100 and all(out[2 * k + 1] == [0] for k in alike)
