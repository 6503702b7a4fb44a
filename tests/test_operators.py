import math
import random
import statistics as st
from collections import Counter

import pytest
from pyspark.sql import functions as F

from grainmill.functions.schedule import Schedule
from grainmill.operators import advantages, audit, catalog, conversation, judging, linking, losses, packing, rebalance, sampling, stratified
from grainmill.streaming import statistics

TINY = [("s1", "H"), ("s1", "M"), ("s2", "H"), ("s2", "M"), ("s3", "H"), ("s4", "H"), ("s5", "H"), ("s6", "T")]


def links(spark, rows=TINY):
    return spark.createDataFrame(rows, "sample_key string, node_id string")


def test_pipeline_on_seven_samples(spark):
    s = Schedule(n_high=5, n_low=2, a_head=math.log10(5) / 2, r_min=0.1, m_max=4)
    universe = spark.createDataFrame([(f"s{i}",) for i in range(1, 8)], "sample_key string")
    counts = rebalance.concept_counts(links(spark))
    assert {r.node_id: r.N_c for r in counts.collect()} == {"H": 5, "M": 2, "T": 1}
    nodes = rebalance.node_multiplicity(counts, s)
    m = {r.sample_key: r.m for r in rebalance.rarest_wins(links(spark), nodes, universe).collect()}
    assert m == pytest.approx({"s1": 1, "s2": 1, "s3": 1, "s4": 1, "s5": 1, "s6": math.sqrt(2), "s7": 1})
    members = rebalance.membership(rebalance.rarest_wins(links(spark), nodes, universe))
    again = rebalance.membership(rebalance.rarest_wins(links(spark).repartition(3), nodes, universe.repartition(2)))
    line = F.concat_ws("\t", "sample_key", "count")
    assert catalog.membership_hash(members, line, "sample_key") == catalog.membership_hash(again, line, "sample_key")
    expanded = Counter(r.sample_key for r in rebalance.expand(members).collect())
    assert expanded == {r.sample_key: r["count"] for r in members.collect()}


@pytest.mark.parametrize("ms,want", [([0.77, 1, 1.58], None), ([0.76, 1, 1, 1], 0.76), ([0.5, 2], 1), ([0, 2], 0), ([100, 100], 4), ([1, 1], 1)])
def test_geometric_mean(spark, ms, want):
    nodes = spark.createDataFrame([(str(i), float(x)) for i, x in enumerate(ms)], "node_id string, m_c double")
    got = rebalance.geometric_mean(links(spark, [("s", str(i)) for i in range(len(ms))]), nodes).first().m
    if want is None:
        logs = [math.log(x) for x in ms]
        want = math.exp(sum(abs(x) * x for x in logs) / sum(map(abs, logs)))
    assert got == pytest.approx(want)


def test_mean_inverse_excludes_and_falls_back(spark):
    counts = spark.createDataFrame([("a", 4), ("b", 100)], "node_id string, N_c long")
    universe = spark.createDataFrame([("x",), ("y",), ("z",), (None,)], "sample_key string")
    rows = [("x", "a"), ("x", "b"), ("y", "b")]
    w = {r.sample_key: r.w for r in rebalance.mean_inverse(links(spark, rows), counts, universe).collect()}
    assert w == pytest.approx({"x": 0.3, "y": 0.1, "z": 0.2})
    gone = spark.createDataFrame([("b",)], "node_id string")
    w = {r.sample_key: r.w for r in rebalance.mean_inverse(links(spark, rows), counts, universe, excluded=gone).collect()}
    assert w == pytest.approx({"x": 0.25, "y": 0.0, "z": 0.25})


@pytest.mark.parametrize("seed", range(4))
def test_budget_matches_the_loop(spark, seed):
    rng = random.Random(seed)
    w = [rng.paretovariate(0.7) for _ in range(300)] + [3.0] * 20
    cap, budget = 4.0, float(len(w))
    m = [x * budget / sum(w) for x in w]
    for _ in range(500):
        over = [min(x, cap) for x in m]
        excess = sum(m) - sum(over)
        free = sum(x for x in over if x < cap)
        if excess < 1e-12 or not free:
            break
        m = [x if x >= cap else x + excess * x / free for x in over]
    got = rebalance.to_budget(spark.createDataFrame([(str(i), x) for i, x in enumerate(w)], "sample_key string, w double"), cap=cap)
    got = {r.sample_key: r.m for r in got.collect()}
    assert [got[str(i)] for i in range(len(w))] == pytest.approx([min(x, cap) for x in m], abs=1e-6)


def test_budget_edges(spark):
    df = lambda rows: spark.createDataFrame(rows, "sample_key string, w double")
    assert rebalance.to_budget(df([])).count() == 0
    assert {r.m for r in rebalance.to_budget(df([("a", 0.0), ("b", None)])).collect()} == {0.0}
    assert {r.m for r in rebalance.to_budget(df([("a", 1.0), ("b", 1.0)]), budget=100, cap=3).collect()} == {3.0}
    assert {r.m for r in rebalance.to_budget(df([("a", 1.0), ("b", 3.0)]), cap=None).collect()} == {0.5, 1.5}


def brute_select(rows, quota, prio):
    by = {}
    for s, n in rows:
        by.setdefault(n, set()).add(s)
    done = set()
    for n in sorted(by, key=lambda n: (len(by[n]), n)):
        need = quota(n, len(by[n])) - len(by[n] & done)
        done |= set(sorted(by[n] - done, key=lambda s: (prio(s), s))[: max(0, need)])
    return done


def test_stratified_is_the_sequential_one(spark):
    import hashlib

    prio = lambda s: int(hashlib.sha256(s.encode()).hexdigest(), 16) % 2**63
    rng = random.Random(3)
    rows = sorted({(f"s{i}", f"n{int(rng.paretovariate(0.6)) % 40}") for i in range(700) for _ in range(rng.randint(1, 6))})
    rate = lambda n: 1.0 if n < 60 else max(0.05, min(1.0, 2.0 / math.log10(n) * 0.5))
    want = brute_select(rows, lambda _, n: max(1, min(n, round(rate(n) * n))), prio)
    limits = stratified.quotas(rebalance.concept_counts(links(spark, rows)), 60, 0.5, 0.05)
    got = stratified.select(links(spark, rows), limits).collect()
    assert {r.sample_key for r in got} == want and len(got) == len(want)


def test_first_by_priority(spark):
    rows = [("g", f"k{i}", i * 2**50 % 2**63, 5) for i in range(50)] + [("h", "a", 1, 9), ("i", "b", 1, 0)]
    df = spark.createDataFrame(rows, "g string, sample_key string, priority long, need long")
    got = stratified.first_by_priority(df, "g", "need").collect()
    assert Counter(r.g for r in got) == {"g": 5, "h": 1}
    assert {r.sample_key for r in got if r.g == "g"} == {r[1] for r in sorted(rows[:50], key=lambda r: (r[2], r[1]))[:5]}


def test_gini_and_top_share(spark):
    for values in ([1, 1, 1, 1], [1, 2, 3, 10, 10, 50], [7]):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        x, n = sorted(values), len(values)
        assert audit.gini(df, "v").first()[0] == pytest.approx(2 * sum(i * v for i, v in enumerate(x, 1)) / (n * sum(x)) - (n + 1) / n)
        k = max(1, round(0.25 * n))
        assert audit.top_share(df, "v", 0.25).first()[0] == pytest.approx(sum(x[-k:]) / sum(x))
    empty = spark.createDataFrame([], "v long")
    assert audit.gini(empty, "v").first()[0] == 0 and audit.top_share(empty, "v").first()[0] == 0


def test_first_wins_ties_and_nulls(spark):
    rows = [("a", 2, "x"), ("a", 1, "y"), ("a", 1, "b"), (None, 0, "n"), ("c", None, "z"), ("c", 5, "w")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    for part in (1, 3):
        got = {(r.k, r.o, r.v) for r in catalog.first_wins(df.repartition(part), "k", "o").collect()}
        assert got == {("a", 1, "b"), ("c", 5, "w")}


def test_enrich(spark):
    index = spark.createDataFrame([(k,) for k in "abcde"], "sample_key string")
    scores = spark.createDataFrame([("a", "0.5", 1), ("a", "0.7", 2), ("b", "x", 1), ("c", "1_0", 1), ("d", "nan", 1), ("z", "1", 1)], "sample_key string, q string, pos int")
    got = {r.sample_key: r.q for r in catalog.enrich(index, scores, ["q"], "pos").collect()}
    assert got["a"] == 0.7 and got["b"] is got["c"] is got["e"] is None and math.isnan(got["d"]) and "z" not in got
    twice = catalog.enrich(catalog.enrich(index, scores, ["q"], "pos"), scores, ["q"], "pos")
    assert twice.columns == ["sample_key", "q"]
    assert catalog.enrich(index, scores.limit(0), ["q"], "pos").count() == 5


def test_enrich_infinite(spark):
    index = spark.createDataFrame([(k,) for k in "abcdef"], "sample_key string")
    texts = [("a", "inf", 1), ("b", "-Infinity", 1), ("c", " +INF ", 1), ("d", "infinit", 1), ("e", "1e400", 1), ("f", "inf1", 1)]
    got = {r.sample_key: r.q for r in catalog.enrich(index, spark.createDataFrame(texts, "sample_key string, q string, pos int"), ["q"], "pos").collect()}
    assert got == {"a": math.inf, "b": -math.inf, "c": math.inf, "d": None, "e": math.inf, "f": None}
    numbers = spark.createDataFrame([("a", math.inf, 1), ("b", -math.inf, 1), ("c", 1.5, 1)], "sample_key string, q double, pos int")
    got = {r.sample_key: r.q for r in catalog.enrich(index, numbers, ["q"], "pos").collect()}
    assert got["a"] == math.inf and got["b"] == -math.inf and got["c"] == 1.5 and got["d"] is None


def test_select_and_scan(spark):
    rows = [(f"k{i}", i, i % 10 / 10) for i in range(20)]
    df = spark.createDataFrame(rows, "sample_key string, priority long, s double")
    keys = lambda x: [r.sample_key for r in x.collect()]
    assert keys(catalog.materialise(df, "s > 0.5", 3)) == ["k6", "k7", "k8"]
    assert keys(catalog.materialise(df, "s > 0.5", 8, "scan")) == ["k6", "k7"]
    assert len(keys(catalog.materialise(df, "", 99))) == 20
    small, large = set(keys(catalog.select_first(df, "s > 0.1", 5))), set(keys(catalog.select_first(df, "s > 0.1", 10)))
    assert small < large
    with pytest.raises(ValueError):
        catalog.materialise(df, "", 1, "other")


def test_tags(spark):
    text = "2 red cats, 'STOP' sign, 42, urban scene, Red  Cats, , freestyle"
    tags = spark.createDataFrame([(text,)], "t string").select(linking.parse_tags(F.col("t"))).first()[0]
    assert tags == ["red cats", "sign", "freestyle"]
    concepts = spark.createDataFrame([("n1", "cats"), ("n2", "sign (board)"), ("n3", "scene"), ("n4", None), ("n5", "Red Cats")], "node_id string, node_name string")
    vocab = spark.createDataFrame([("red cats",), ("sign",), ("scene",), (None,)], "tag string")
    got = {(r.tag, r.node_id, r.score) for r in linking.match_tags(vocab, concepts).collect()}
    assert got == {("red cats", "n5", 1.0), ("sign", "n2", 1.0)}


def test_split_forms(spark):
    rows = [("a", 40000, "pitcher (container)"), ("b", 254, "Pitcher"), ("c", 20, "garum"), ("d", 30, "garum (sauce)"), ("e", 1000, "pitcher (x)"), ("f", 5, None)]
    df = spark.createDataFrame(rows, "node_id string, N_c long, node_name string")
    assert [r.node_id for r in rebalance.split_forms(df, 1000).collect()] == ["b"]


def test_extract_prompt_and_unpair(spark):
    schema = "id int, chosen array<struct<role:string,content:string>>, rejected array<struct<role:string,content:string>>"
    u, a, b = ("user", "q"), ("assistant", "a"), ("assistant", "b")
    df = spark.createDataFrame([(1, [u, a], [u, b]), (2, [u, a], [u, a]), (3, [], [u]), (4, None, [u]), (5, [a], [b])], schema)
    got = {r.id: (len(r.prompt or []), len(r.chosen or []), len(r.rejected or [])) for r in conversation.extract_prompt(df).collect()}
    assert got == {1: (1, 1, 1), 2: (1, 1, 1), 3: (0, 0, 1), 4: (0, 0, 1), 5: (0, 1, 1)}
    assert conversation.unpair(df).count() == 10
    assert conversation.shape(df.drop("id")) == "implicit preference"
    with pytest.raises(ValueError):
        conversation.shape(df.select("id", "chosen"))


def test_converters(spark):
    four = spark.createDataFrame([("q", 1, "a", "b", "c", "d"), ("r", 0, "x", "x", "x", "x")], "query string, best int, sample0 string, sample1 string, sample2 string, sample3 string")
    assert [tuple(r) for r in conversation.from_four(four).collect()] == [("q", "b", "a")]
    marked = spark.createDataFrame([("Ask? Step 1: one ки\nStep 2: two ки", "Ask? Step 1: one +\nStep 2: two -")], "input string, label string")
    r = conversation.from_marked_steps(marked).first()
    assert (r.prompt, r.completions, r.labels) == ("Ask?", ["Step 1: one", "Step 2: two"], [True, False])
    tree = spark.createDataFrame([("p", [([("a", 1), ("b", -1)], 0), ([("c", 1)], 0)])], "problem string, steps array<struct<completions:array<struct<text:string,rating:int>>,chosen:int>>")
    got = sorted((r.completions, r.labels) for r in conversation.from_step_tree(tree).collect())
    assert got == [(["a", "c"], [True, True]), (["b"], [False])]
    talk = spark.createDataFrame([("\n\nHuman: q\n\nAssistant: x", "\n\nHuman: q\n\nAssistant: y")], "chosen string, rejected string")
    r = conversation.from_transcripts(talk).first()
    assert [t.content for t in r.prompt] == ["q"] and r.chosen[0].content == "x"
    posts = spark.createDataFrame([("s", "t", "p", "sum")], "subreddit string, title string, post string, summary string")
    assert conversation.from_posts(posts).first().completion == " sum"
    rated = spark.createDataFrame([("i", ["m", "n"], [("a", "5"), ("b", "N/A")])], "instruction string, models array<string>, completions array<struct<response:string,rating:string>>")
    assert conversation.from_ratings(rated, "m").first().label is True and conversation.from_ratings(rated, "n").first().label is None


def test_packing(spark):
    rows = spark.createDataFrame([(0, 0, [1, 2, 3]), (0, 1, [4, 5]), (0, 2, [6, 7, 8]), (0, 3, [9])], "pack_group long, id long, tokens array<int>")
    got = [r.tokens for r in packing.pack_best_fit(rows, 4).orderBy("bin").collect()]
    assert got == [[1, 2, 3, 9], [6, 7, 8], [4, 5]]
    wrapped = [r.tokens for r in packing.pack_wrapped(rows, 4).orderBy("piece").collect()]
    assert wrapped == [[1, 2, 3, 4], [5, 6, 7, 8], [9]]
    odd = spark.createDataFrame([(0, 0, None), (0, 1, []), (0, 2, list(range(9)))], "pack_group long, id long, tokens array<int>")
    out = packing.pack_best_fit(odd, 4).collect()
    assert sorted(sum((r.seq_lengths for r in out), [])) == [0, 0, 4]


def test_ranks_and_samplers(spark):
    df = spark.range(0, 103).withColumn("v", F.col("id") % 10)
    places = [(r.v, r.id, r.place) for r in sampling.ranked(df, "v", "id").collect()]
    assert [p for *_, p in sorted(places)] == list(range(103))
    split = Counter(r.split for r in sampling.exact_split(df, "id", 0.1).collect())
    assert split == {"train": 92, "test": 11}
    seven = spark.range(7)
    plan = sampling.repeat_plan(seven, "id", 3, 2, 4).orderBy("position").collect()
    assert len(plan) == 48 and [r.position for r in plan] == list(range(48)) and all(plan[2 * i].id == plan[2 * i + 1].id for i in range(24))
    assert len({r.id for r in plan}) == 6
    grouped = sampling.length_grouped(df, "id", "v", 4, 2).collect()
    assert Counter(r.id for r in grouped) == Counter(range(103))


def test_advantages(spark):
    rows = [(g, i, float(v)) for g, vs in {"a": [1, 2, 6], "b": [3, 3], "c": [5]}.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "g string, i int, r double")
    got = {(r.g, r.i): r.advantage for r in advantages.group_relative(df, "g", "r").collect()}
    assert got["a", 2] == pytest.approx(3 / (st.stdev([1, 2, 6]) + 1e-4)) and got["b", 0] == got["c", 0] == 0
    loo = {(r.g, r.i): r.advantage for r in advantages.leave_one_out(df, "g", "r").collect()}
    assert loo["a", 2] == 4.5 and loo["c", 0] is None
    total = df.withColumn("n", F.lit(float("nan"))).select(advantages.total_reward({"r": 2, "n": 1}).alias("t"))
    assert total.agg(F.sum("t")).first()[0] == 40
    best = {r.g: r.i for r in advantages.best_of(df, "g", "r", "i").collect()}
    assert best == {"a": 2, "b": 0, "c": 0}


def test_rolling_mean_over_blocks(spark):
    xs = [float(i * i % 17) for i in range(95)]
    df = spark.createDataFrame(list(enumerate(xs)), "i int, v double")
    got = {r.i: r.rolling for r in advantages.rolling_mean(df, "i", "v", 10, block=20).collect()}
    assert got == {i: pytest.approx(sum(xs[i - 9 : i + 1]) / 10) if i >= 9 else None for i in range(95)}


def test_judging(spark):
    df = spark.createDataFrame([([1, 1],), ([1, 0],), ([1, -1],)], "v array<int>")
    assert [r.x for r in df.select(judging.all_true(F.col("v")).alias("x")).collect()] == [1, 0, -1]
    with pytest.raises(Exception, match="verdicts"):
        spark.createDataFrame([([2],)], "v array<int>").select(judging.all_true(F.col("v"))).collect()
    ranks = spark.createDataFrame([(0, True), (1, True), (-1, True), (1, False)], "r int, f boolean")
    assert [r.x for r in ranks.select(judging.unflipped(F.col("r"), F.col("f")).alias("x")).collect()] == [1, 0, -1, 1]


def test_losses_are_checked(spark):
    p = losses.Pair(F.lit(-1.0), F.lit(-2.0), F.lit(-1.5), F.lit(-1.5))
    with pytest.raises(ValueError):
        losses.dpo_loss("nope", p)
    with pytest.raises(ValueError):
        losses.dpo_loss("bco_pair", p)
    x = spark.range(1).select(losses.dpo_loss("sigmoid", p).alias("a"), losses.dpo_loss("bco_pair", p, delta=F.lit(0.0)).alias("b"), losses.dpo_loss("sigmoid", p, divergence="js").alias("c"), losses.dpo_loss("sigmoid", p, divergence="alpha").alias("d")).first()
    assert x.a == pytest.approx(math.log1p(math.exp(-0.1))) and x.b > 0 and x.c > 0 and x.d > 0


def test_running_moments_and_tracker(spark):
    rng = random.Random(2)
    rows = [(i, i // 20, rng.choice("ab"), rng.gauss(0, 3)) for i in range(200)]
    df = spark.createDataFrame(rows, "i int, step int, p string, v double")
    last = statistics.running_moments(df, "step", "v").orderBy(F.desc("step")).first()
    assert last.n == 200 and last.mean == pytest.approx(st.mean(r[3] for r in rows)) and last.var == pytest.approx(st.pvariance([r[3] for r in rows]))
    got = {r.i: r.advantage for r in statistics.tracked_advantages(df, "p", "step", "v", "i", 16, 8).collect()}
    buffers = {}
    for s in range(10):
        batch = [r for r in rows if r[1] == s]
        for r in batch:
            buffers[r[2]] = (buffers.get(r[2], []) + [r[3]])[-16:]
        for r in batch:
            x = buffers[r[2]] if len(buffers[r[2]]) >= 8 else [b[3] for b in batch]
            assert got[r[0]] == pytest.approx((r[3] - st.mean(x)) / (st.pstdev(x) + 1e-6))


def test_merged_moments():
    state = (statistics.PRIOR, 0.0, 1.0)
    xs = [[1.0, 2.0, 4.0], [8.0], [3.0, 3.0]]
    for x in xs:
        state = statistics.merged(state, (float(len(x)), st.mean(x), st.pvariance(x)))
    alls = sum(xs, [])
    assert state == pytest.approx((6, st.mean(alls), st.pvariance(alls)))


def test_streams(spark, tmp_path):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", 1.0)], "p string, v double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("moments", statistics.stream_running_moments(stream, "p", "v")), ("tracker", statistics.stream_prompt_tracker(stream, "p", "v", 4))):
        q = out.writeStream.format("memory").queryName(name).outputMode("update").start()
        q.processAllAvailable()
        q.stop()
    assert {r.p: r["mean"] for r in spark.table("moments").collect()} == pytest.approx({"a": 4.5, "b": 1.0})
    assert {r.p: (r.n, r["mean"]) for r in spark.table("tracker").collect()} == {"a": (4, 7.5), "b": (1, 1.0)}
