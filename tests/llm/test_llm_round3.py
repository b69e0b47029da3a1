"""Centroid clustering, tournament packing and importance resampling against plain versions."""

import hashlib
import itertools
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from photospark.llm import centroids, resampling, tournament
from photospark.llm import queries as Q
from photospark.llm.packing import Encoder
from photospark.llm.stage import Stage

PATH = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, cluster string, ids string"


def test_hilbert_curve_takes_unit_steps_and_meets_every_cell_once():
    for axes, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=axes)))
        order = centroids.hilbert(cells, bits)
        assert sorted(order.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(order)], axis=0)).sum(1) == 1).all()


def test_boxes_never_lose_the_nearest_centroid():
    rng = np.random.default_rng(3)
    decided = 0
    for spread in (1, 4, 40):
        for _ in range(60):
            c = rng.integers(-20, 20, (7, 5))
            c[3] = c[1]
            x = rng.integers(-20, 20, 5) + rng.integers(-spread, spread + 1, (30, 5))
            kept = centroids.candidates(x.min(0)[None], x.max(0)[None], c)[0]
            nearest = ((x[:, None] - c[None]) ** 2).sum(-1).argmin(1)
            assert kept[np.unique(nearest)].all()
            decided += kept.sum() == 1
    assert decided > 30


def plain_clusters(rows, many=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:many]
    c = [v for _, v in start]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, w)), k) for k, w in enumerate(c))

    for _ in range(rounds):
        own = [(near(v)[1], v) for _, v in kept]
        c = [[sum(col) // len(col) for col in zip(*[v for k, v in own if k == j])] if any(k == j for k, _ in own) else w for j, w in enumerate(c)]
    out = [(i, *near(v)) for i, v in kept]
    total = {k: sum(d for _, d, j in out if j == k) for k in range(len(c))}
    return sorted(((i if i is not None else -1, k, d, total[k], sum(total.values()), hashlib.sha256(",".join(map(str, c[k])).encode()).hexdigest()) for i, d, k in out))


def clustered(spark, rows):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], VECTORS)
    out = centroids.cluster(df, Stage(spark, "t"))
    cols = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert out.columns == cols
    return sorted(tuple(-1 if x is None else x for x in r) for r in out.collect())


def test_clusters_equal_plain_ones(spark):
    rng = random.Random(5)
    hubs = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    rows = [(i, [h + rng.gauss(0, 0.1) for h in hubs[i % 5]]) for i in range(150)]
    rows += [(1000 + i, hubs[0]) for i in range(120)] + [(7, hubs[1]), (7, hubs[1]), (7, hubs[2]), (None, hubs[3]), (None, hubs[3])]
    rows += [(2000, None), (2001, [0.0] * 63), (2002, [0.0] * 65), (2003, [None] + [0.0] * 63), (2004, [float("nan")] + [0.0] * 63), (2005, [float("-inf")] + [0.0] * 63), (2006, [])]
    assert clustered(spark, rows) == plain_clusters(rows)
    assert clustered(spark, rows[:9]) == plain_clusters(rows[:9])  # fewer vectors than centroids
    far = [(1, [1e300] + [-1e300] * 63), (2, [16384.0] + [-16384.0] * 63)]
    assert [r[2] for r in clustered(spark, far)] == [0, 0]  # both held within the limit
    assert clustered(spark, rows[-7:]) == [] and clustered(spark, []) == []


def test_cluster_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{PATH}/embeddings.parquet'")
    cur = con.execute(Q.SQL["op11_hilbert_centroids"])
    got = Q.op11_hilbert_centroids(spark, PATH).select(*[d[0] for d in cur.description])
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())


def test_a_hot_vector_is_spread_over_blocks_of_many_tasks(spark):
    rng = random.Random(6)
    one = [rng.gauss(0, 1) for _ in range(64)]
    df = spark.createDataFrame([(i, one if i % 2 else [rng.gauss(0, 1) for _ in range(64)]) for i in range(4000)], "vec_id long, embedding array<double>")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        cut = centroids.blocks(centroids.usable(df, "vec_id", "embedding"), Stage(spark, "t"))
        sizes = [r["n"] for r in cut.groupBy(F.input_file_name()).agg(F.sum("n").alias("n")).collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(sizes) == 4000 and len(sizes) >= 3 and max(sizes) < 2000


def test_boxes_leave_few_candidates_where_vectors_have_structure(spark):
    rng = np.random.default_rng(12)
    hubs = rng.normal(0, 1, (8, 64))
    df = spark.createDataFrame([(i, (hubs[i % 8] + rng.normal(0, 0.05, 64)).tolist()) for i in range(4000)], "vec_id long, embedding array<double>")
    cut = centroids.blocks(centroids.usable(df, "vec_id", "embedding"), Stage(spark, "t")).select("lo", "hi").collect()
    kept = centroids.candidates(*(np.array([r[c] for r in cut], np.int64) for c in ("lo", "hi")), np.floor(hubs * 64).astype(np.int64))
    assert (kept.sum(1) == 1).mean() > 0.5 and kept.any(1).all()


def test_tournament_equals_plain_first_fit():
    rng = random.Random(7)
    for n in (0, 1, 2, 3, 17, 200):
        lengths = [rng.randint(1, 100) for _ in range(n)]
        want, room = [], []
        for k in sorted(range(n), key=lambda k: -lengths[k]):
            spot = next((b for b, r in enumerate(room) if r >= lengths[k]), None)
            if spot is None:
                want.append([]), room.append(100)
                spot = len(want) - 1
            want[spot].append(k)
            room[spot] -= lengths[k]
        assert tournament.first_fit(lengths, 100) == want
        cut = tournament.fill(want, lengths, 100)
        assert sorted((i, s + j) for own in cut for i, s, m in own for j in range(m)) == [(k, j) for k in range(n) for j in range(lengths[k])]
        sizes = [sum(m for _, _, m in own) for own in cut]
        assert all(s == 100 or s & (s - 1) == 0 for s in sizes) and sizes.count(100) >= sum(lengths) // 100
        assert all(m > 0 for own in cut for _, _, m in own)
    with pytest.raises(ValueError):
        tournament.first_fit([101], 100)


def check_packing(spark, rows, **limits):
    df = spark.createDataFrame([(i, t, 1, "x", b"y") for i, t in rows], "doc_id long, text string, start int, rest string, tokens binary")
    made = tournament.pack(df, Q.TOKENIZER, Stage(spark, "t"), **limits).collect()
    encoder, size = Encoder(Q.TOKENIZER), limits.get("size", 1024)
    want = sorted((-1 if i is None else i, (np.frombuffer(encoder.encode(t), "<u4").tolist() + [0])) for i, t in rows)
    found = []
    for s in made:
        ids, at = np.frombuffer(s["tokens"], "<u4").tolist(), 0
        assert len(ids) == s["length"] <= size and s["padded"] == s["length"]
        for p in s["pieces"]:
            assert p["offset"] == at and p["length"] > 0
            found.append((-1 if p["doc_id"] is None else p["doc_id"], p["start"], ids[at:at + p["length"]], p["doc_tokens"]))
            at += p["length"]
        assert at == len(ids)
    assert len({s["sequence_id"] for s in made}) == len(made)
    assert sum(len(t) for _, t in want) == sum(len(t) for _, _, t, _ in found)
    if len({i for i, _ in want}) == len(want):
        back = {}
        for i, start, ids, n in sorted(found, key=lambda f: f[:2]):
            assert len(back.setdefault(i, [])) == start and n == len(dict(want)[i])
            back[i] += ids
        assert sorted(back.items()) == want
    return made


def test_packing_reads_back(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice(["tree", "bird", "é", "<|endoftext|>", "\n"]) for _ in range(rng.randint(0, 90)))) for i in range(300)]
    rows += [(400, None), (401, ""), (402, "word " * 3000), (None, "alone")]
    made = check_packing(spark, rows, size=64, group=50)
    assert len(check_packing(spark, rows)) < len(made)
    check_packing(spark, rows[:1])
    check_packing(spark, [(1, "same text")] * 40 + [(None, None)] * 3, size=16, group=8)
    check_packing(spark, [(1, "x " * 63), (2, "x " * 127)], size=64)  # no rest at all in full pieces
    assert check_packing(spark, []) == []


def test_packing_query_digest(spark):
    docs = dict(spark.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "text").collect())
    encoder, seen, place = Encoder(Q.TOKENIZER), {}, {}
    for r in Q.op12_tournament_packing(spark, PATH).collect():
        ids = np.append(np.frombuffer(encoder.encode(docs[r["doc_id"]]), "<u4"), np.uint32(0)).astype("<u4")
        assert zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids)
        seen.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans, whole in ((seen, False), (place, True)):
        for own in spans.values():
            at = 0
            for start, length in sorted(own):
                assert start == at
                at += length
            assert not whole or at == 1024 or at & (at - 1) == 0
    assert set(seen) == set(docs)


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def runs(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return w, [x.encode() for x in w + [" ".join(p) for p in zip(w, w[1:])]]


def plain_resample(docs, target, percent=25, many=10_000):
    s, t = [0] * many, [0] * many
    for counts, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f in runs(text)[1]:
                counts[zlib.crc32(f) % many] += 1
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + many) / ((a + 1) * (sum(t) + many)))) for a, b in zip(s, t)]
    out = []
    for i, text in docs:
        w, f = runs(text)
        weight = sum(gain[zlib.crc32(x) % many] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([-1 if i is None else i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w)])
    ready = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] == -1, r[0], -r[2], -r[1]))
    ranks = [(r, k if k <= percent * len(ready) // 100 else None) for k, r in enumerate(ready, 1)] + [(r, None) for r in out if r[4] < 20]
    return sorted((*r, -1 if k is None else k) for r, k in ranks)


def resampled(spark, docs, target):
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, bucket string")
    goal = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    out = resampling.resample(df, goal, Stage(spark, "t"))
    return sorted(tuple(-1 if x is None else x for x in r) for r in out.select("doc_id", "n_features", "weight", "score", "n_words", "rank").collect())


def test_table_gives_the_crc_of_any_span():
    rng = random.Random(9)
    for size in (1, 2, 3, 255, 256, 257, 258, 259, 511, 512, 513, 3000, 2_500_000):
        data = np.frombuffer(rng.randbytes(size), np.uint8)
        if size <= resampling.REACH:
            assert int(resampling.span_crc(data, np.array([size]))[0] ^ resampling.CONSTANT[size]) == zlib.crc32(data.tobytes())
        else:
            assert resampling.long_crc([data[:size // 3], data[size // 3:]]) == zlib.crc32(data.tobytes())
    assert not len(resampling.span_crc(np.zeros(0, np.uint8), np.zeros(0, np.int64)))


def test_features_of_odd_texts(monkeypatch):
    rng = random.Random(10)
    texts = [None, "", " .,", "Ä", "one", "a" * 300 + " b " + "c" * 250 + " d " + "é" * 400, "x" * 255, "y" * 253 + " zz " + "w" * 253 + "-u"]
    texts += ["".join(rng.choice("abZ9é漢 .\n") for _ in range(rng.randint(1, 400))) for _ in range(60)]
    for step in (1 << 20, 64):
        monkeypatch.setattr(resampling, "STEP", step)
        got = {}
        for own, bucket, text in resampling.buckets_of(pa.array(texts, pa.string())):
            for k, b in zip(text.tolist(), bucket.tolist()):
                got.setdefault(k, []).append(b)
        for k, text in enumerate(texts):
            assert sorted(got.get(k, [])) == sorted(zlib.crc32(f) % 10_000 for f in runs(text)[1])


def test_resampling_equals_plain(spark):
    rng = random.Random(11)
    vocabulary = ["river", "Stone", "ember", "x" * 300, "naïve", "9lives", "the"]
    docs = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 60)))) for i in range(120)]
    docs += [(200, None), (201, ""), (202, "?!"), (None, "the river " * 30), (5, docs[5][1]), (5, docs[5][1]), (5, "stone " * 40)]
    target = ["the river the river ember", None, "", "naïve stone"]
    assert resampled(spark, docs, target) == plain_resample(docs, target)
    assert resampled(spark, docs, []) == plain_resample(docs, [])
    assert resampled(spark, [], target) == []


def test_resampling_query_equals_plain(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{PATH}/documents.parquet").select("doc_id", "text").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{PATH}/benchmark.parquet").select("text").collect()]
    out = Q.op13_importance_resampling(spark, PATH).select("doc_id", "n_features", "weight", "score", "n_words", "rank")
    assert sorted(tuple(-1 if x is None else x for x in r) for r in out.collect()) == plain_resample(docs, target)
