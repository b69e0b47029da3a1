"""Chat formatting, URL rules, the pipeline and the registration."""

import hashlib
import random
from statistics import NormalDist

import duckdb
from pyspark.sql import functions as F

import brute
import corpus_pipeline
import test_llm_documents as D
from photospark.llm import chat, urls
from photospark.llm import queries as Q
from photospark.llm.stage import Stage

PATH = "/root/testdata/sf0.001"


def test_chat_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{PATH}/conversations.parquet'")
    cur = con.execute(Q.SQL["op9_chat_format"])
    names = [d[0] for d in cur.description]
    got = Q.op9_chat_format(spark, PATH).select(*names)
    assert sorted(map(tuple, got.collect())) == sorted(cur.fetchall())


def test_chat_merges_and_reads_back(spark):
    tricky = ["", None, "</s>\n", "[NEXT]", "␛1␛0", "<s>[ROLE]x[/ROLE]", "<", "[", "␛", "a\n[INST", "[/INST]</s>", "ünï 🙂"]
    rows = [(1, k, ["user", "assistant", "assistant", None][k % 4], t, "extra") for k, t in enumerate(tricky)]
    rows += [(2, None, "[ROLE]", "first", "x"), (2, 0, "assistant", "b", "x"), (2, 0, "assistant", "a", "x"), (2, 0, "assistant", "a", "x"), (None, 1, "user", "alone", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    out = chat.format_conversations(df)
    back = {r["conv_id"]: [tuple(t) for t in r["ts"]] for r in out.select("conv_id", chat.read_back(F.col("formatted")).alias("ts")).collect()}
    assert back[1] == [(r[2] or "", r[3] or "") for r in rows[:len(tricky)]]
    assert back[2] == [("[ROLE]", "first"), ("assistant", "a"), ("assistant", "a"), ("assistant", "b")] and back[None] == [("user", "alone")]
    said = {r["conv_id"]: (r["loss_sha256"], r["loss_chars"], r["n_turns"]) for r in chat.digest(out).collect()}
    loss = "".join(r[3] or "" for r in rows[:len(tricky)] if r[2] == "assistant")
    assert said[1] == (hashlib.sha256(loss.encode()).hexdigest(), len(loss), len(tricky)) and said[2][1] == 3
    assert out.where("conv_id = 2").first()["formatted"].count(chat.NEXT) == 2
    assert chat.digest(chat.format_conversations(df.where("turn > 99"))).count() == 0


LISTS = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]


def test_url_lists(spark):
    want = {
        "http://Blog.EXAMPLE.org/es/1?x": ("blog.example.org", "/es/1", "example.org/es/", "block"), "https://notexample.org/es/": ("notexample.org", "/es/", "org/", "allow"),
        "ftp://org": ("org", "", None, "allow"), "http://a.com/de/": ("a.com", "/de/", "com/de/", "block"), "http://a.com#/de/": ("a.com", "", None, "allow"),
        "http://u://b.com/fr/x": ("u:", "//b.com/fr/x", None, "allow"), "no scheme": ("", "", None, "allow"), "": ("", "", None, "allow"), None: ("", "", None, "allow"),
        "x://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"), "x://" + "a/" * 30_000: ("a", "/" + "a/" * 29_999, None, "allow")}
    df = spark.createDataFrame([(i, u, "h", "v") for i, u in enumerate(want)], "page_id long, url string, host string, verdict string")
    labels = spark.createDataFrame([], "page_id long, blocked boolean")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(df, labels, LISTS, Stage(spark, "t")).collect()}
    assert got == dict(enumerate(want.values()))
    assert urls.filter_urls(df.where("page_id < 0"), labels, LISTS, Stage(spark, "t")).count() == 0


def test_mined_rules_equal_counting(spark):
    import itertools
    import random

    rng = random.Random(16)
    rows = []
    for i in range(400):
        parts = rng.sample(["ads", "win", "news", "blog", "shop", "free"], 3)
        rows.append((i, f"http://site{i % 3}.net/{'/'.join(parts)}", {"ads", "win"} <= set(parts) or rng.random() < 0.03))
    df = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    limits = {"min_support": 0.02, "min_count": 5, "min_confidence": 0.7, "min_lift": 2.0}
    mined = {tuple(sorted(r["items"])): round(r["confidence"], 9) for r in urls.mine_rules(df, Stage(spark, "t"), **limits).collect()}
    sets = [(frozenset(r["t"]), r["blocked"]) for r in df.select(urls.tokens_of(F.col("url")).alias("t"), "blocked").collect()]
    items, base = sorted(set().union(*[s for s, _ in sets])), sum(b for _, b in sets) / len(sets)
    want = {}
    for n in (1, 2, 3, 4, 5, 6):
        for c in itertools.combinations(items, n):
            own = [b for s, b in sets if s >= set(c)]
            if sum(own) >= 0.02 * len(sets) and sum(own) >= 0.7 * len(own) and sum(own) / len(own) >= 2 * base:
                want[c] = round(sum(own) / len(own), 9)
    assert mined == want and ("p:ads", "p:win") in mined
    out = urls.filter_urls(df.select("page_id", "url"), df.select("page_id", "blocked"), [], Stage(spark, "t"), **limits).collect()
    for r, (s, _) in zip(sorted(out), sets):
        hit = [c for c in want if s >= set(c)]
        assert r["verdict"] == ("block" if hit else "allow") and (not hit or round(r["confidence"], 9) == max(want[c] for c in hit))


def test_tokens_that_rank_low_alone_make_rules(spark):
    noisy = [(f"http://a.net/noise{chr(97 + k)}", i < 6) for k in range(20) for i in range(10)]
    pair = [("http://a.net/ads/win", True)] * 30 + [("http://a.net/ads", False)] * 100 + [("http://a.net/win", False)] * 100 + [("http://a.net/ok", False)] * 200
    df = spark.createDataFrame([(i, u, b) for i, (u, b) in enumerate(noisy + pair)], "page_id long, url string, blocked boolean")
    limits = {"min_support": 0.005, "min_count": 5, "min_confidence": 0.7, "min_lift": 2.0}
    mined = {tuple(sorted(r["items"])): r["anchor"] for r in urls.mine_rules(df, Stage(spark, "t"), **limits).collect()}
    assert ("p:ads", "p:win") in mined and mined["p:ads", "p:win"] == "p:ads"
    out = urls.filter_urls(df.select("page_id", "url"), df.select("page_id", "blocked"), [], Stage(spark, "t"), **limits)
    assert {r["page_id"] for r in out.where("verdict = 'block'").collect()} == set(range(200, 230)) and out.count() == df.count()


def test_url_rules_hold_on_other_urls(spark):
    rng = random.Random(31)
    rows = []
    for i in range(3000):
        bad, shop = rng.random() < 0.1, rng.random() < 0.1
        # two tokens together mark half of the pages as blocked, either alone fewer, others none
        own = (["deals"] if shop or rng.random() < 0.2 else []) + (["cheap"] if shop or rng.random() < 0.2 else [])
        rows.append((i, f"http://h{rng.randrange(9)}.net/{'/'.join([*own, f'w{rng.randrange(30)}'])}/{i}", bad or (shop and rng.random() < 0.5)))
    df = spark.createDataFrame(rows, "page_id long, url string, blocked boolean")
    limits = {"fold": 3, "min_confidence": 0.0, "min_lift": 1.5}
    stage = Stage(spark, "t")
    found = {frozenset(r["items"]): r for r in urls.learn_rules(df, stage, **limits).collect()}
    both = frozenset({"p:deals", "p:cheap"})
    assert both in found and both <= max(found, key=lambda k: found[k]["confidence"]) and all(both & k for k in found)
    held = [(set(r["t"]), r["blocked"]) for r in df.where(F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(3)) == 0).select(urls.tokens_of(F.col("url")).alias("t"), "blocked").collect()]
    tested = spark.read.parquet(f"{stage.root}/rules").collect()
    z = NormalDist().inv_cdf(1 - 0.05 / len(tested))
    for r in tested:
        own = [b for t, b in held if set(r["items"]) <= t]
        assert (r["n"] or 0) == len(own) and (r["bad"] or 0) == sum(own)
        if own:
            n, x = len(own), sum(own) / len(own)
            low = (x + z * z / 2 / n - z * (x * (1 - x) / n + z * z / 4 / n / n) ** 0.5) / (1 + z * z / n)
            assert abs(low - r["low"]) < 1e-9 and r["holds"] == (low > sum(b for _, b in held) / len(held))
        assert not any(set(o["items"]) < set(r["items"]) and o["confidence"] >= r["confidence"] for o in tested)
    out = urls.filter_urls(df.select("page_id", "url"), df.select("page_id", "blocked"), [], Stage(spark, "t"), **limits)
    assert out.where("verdict = 'block'").count() > 200
    noise = df.withColumn("blocked", F.pmod(F.xxhash64("page_id"), F.lit(7)) == 0)
    assert urls.learn_rules(noise, Stage(spark, "t"), **limits).count() == 0


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{PATH}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{PATH}/benchmark.parquet").collect()]
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, PATH).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == "best_fit_packing":
            assert {r["doc_id"] for r in docs.collect()} == set(before)
            break
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns
        if name == "quality_rules":
            base = {d for d, t in before.items() if (n := brute.rule_counts(t))[0] < 50 or 100 * n[4] > 50 * n[0]}
            assert not base & set(after) and all(before[d] == t for d, t in after.items())
            good = {r["doc_id"] for r in spark.read.parquet(f"{PATH}/labels.parquet").where("quality = 1").collect()}
            assert len(good & set(before) - base - set(after)) <= 1
        elif name == "line_dedup":
            assert set(after) == set(before) and docs.where("n_chars <> length(text)").count() == 0
            rows = [(d, t) for d, t in before.items()]
            gone = brute.repeated_lines(rows, D.lines.edits)
            assert after == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone.get(d, ())) for d, t in rows}
        elif name == "near_dedup":
            want, _ = brute.near_components(before.items())
            assert set(after) == {d for d, c in want.items() if d == c}
        else:
            from photospark.llm import decontaminate

            seeds = decontaminate.Seeds(items)
            dirty = {d for d, t in before.items() if brute.leaks(t, [items[k] for k in seeds.shared(decontaminate.tokens(t))])}
            assert set(after) == set(before) - dirty


def test_odd_tables_go_through_the_pipeline(spark, tmp_path):
    for rows in ([], [(1, None), (2, ""), (None, "x"), (3, "a b c d e " * 30), (3, "a b c d e " * 30), (4, " ".join(f"q{i}" for i in range(99)))]):
        docs = spark.createDataFrame([(i, t, "x", 1, 2, "s") for i, t in rows], "doc_id long, text string, leaks string, dropped int, rest int, _row string")
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, PATH)
            assert name == "best_fit_packing" or docs.columns == columns
            docs.write.parquet(out := str(tmp_path / f"{len(rows)}-{name}"))
            docs = spark.read.parquet(out)
        assert {r["doc_id"] for r in docs.collect()} == ({4} if rows else set())


def test_verdicts_follow_rows_not_ids(spark, tmp_path):
    good = [" ".join(f"{w}{i}" for i in range(150)) for w in ("alpha", "beta", "gamma")]
    rows = [(1, good[0]), (1, "bad"), (None, "bad"), (None, "x"), (2, good[1]), (None, good[2]), (None, good[2]), (2, good[1]), (9, good[2] + " end"), (None, good[0] + " end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "docs"))
    for table in (docs, spark.read.parquet(str(tmp_path / "docs"))):
        kept = corpus_pipeline.quality_rules(spark, table, PATH)
        assert sorted(map(str, kept.collect())) == sorted(str(r) for r in docs.collect() if len(r["text"]) > 9)
        once = corpus_pipeline.near_dedup(spark, kept, PATH)
        assert sorted(tuple(r) for r in once.collect()) == [(1, good[0]), (2, good[1]), (9, good[2] + " end")]


def test_registration():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert set(entry.oracle_sql()) <= set(names)
