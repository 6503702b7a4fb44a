import random
import tarfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from grainmill.context import planned_bytes
from grainmill.functions import sequences, text as X
from grainmill.operators import advantages, rebalance, sampling
from grainmill.sources import webdataset
from grainmill.streaming import statistics


def test_quantiles_against_numpy(spark):
    rng = random.Random(1)
    rows = [("a", rng.choice([1.0, 2.0, rng.random()])) for _ in range(301)] + [("b", 5.0)] * 200 + [("c", None), (None, 1.0), (None, 4.0), ("d", float("nan")), ("d", 7.0)]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("_c", F.lit(1))
    for q in (0.0, 0.5, 0.8, 1.0):
        got = {r.g: r.quantile for r in sampling.quantiles(df, "v", q, "g").collect()}
        assert set(got) == {"a", "b", "c", "d", None} and got["c"] is None and got["d"] == 7.0
        for g in ("a", "b", None):
            assert abs(got[g] - np.quantile([v for k, v in rows if k == g], q)) < 1e-12
        known = [v for _, v in rows if v is not None and v == v]
        assert abs(sampling.quantiles(df, "v", q).first()[0] - np.quantile(known, q)) < 1e-12
    assert sampling.quantiles(df.limit(0), "v", 0.5).first()[0] is None and sampling.quantiles(df.limit(0), "v", 0.5, "g").count() == 0


def test_node_table_is_broadcast_by_its_own_size(spark):
    links = spark.range(1000).selectExpr("cast(id % 50 as string) sample_key", "cast(id % 7 as string) node_id").distinct()
    nodes = rebalance.concept_counts(links).withColumn("m_c", F.lit(1.0))
    huge = links.join(spark.range(1 << 40).select(F.col("id").cast("string").alias("sample_key")), "sample_key")
    assert planned_bytes(huge) > 1 << 30
    plan = rebalance.rarest_wins(huge, nodes)._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=broadcast)" in plan or "strategy=broadcast" in plan


def test_moments_at_large_means(spark):
    rng = random.Random(2)
    rows = [(i // 10, 1e9 + rng.random()) for i in range(100)] + [(20, None)]
    got = statistics.running_moments(spark.createDataFrame(rows, "s int, v double"), "s", "v").orderBy("s").collect()
    for r in got:
        seen = [v for s, v in rows if s <= r.s and v is not None]
        assert r.n == len(seen) and abs(r["var"] - np.var(np.array(seen) - 1e9)) < 1e-6
    empty = statistics.running_moments(spark.createDataFrame([(1, None)], "s int, v double"), "s", "v").first()
    assert empty.n == 0 and empty["mean"] is None


def test_hot_prompts_are_cut_before_they_are_gathered(spark):
    rng = random.Random(3)
    rows = [(i, "hot" if rng.random() < 0.9 else "p", i // 200, rng.random()) for i in range(1000)]
    df = spark.createDataFrame(rows, "i int, p string, s int, v double")
    got = {r.i: r.advantage for r in statistics.tracked_advantages(df, "p", "s", "v", "i", 32, 16).collect()}
    for i, p, s, v in rows:
        held = [x for _, q, t, x in rows if q == p and t <= s][-32:]
        x = np.array(held if len(held) >= 16 else [y for _, _, t, y in rows if t == s])
        assert abs(got[i] - (v - x.mean()) / (x.std() + 1e-6)) < 1e-6


def test_prefixes_and_protected_tokens(spark):
    rows = [("abcx", "abcy"), ("", "a"), ("same", "same"), ("ab", "abc"), ("x" * 5000 + "1", "x" * 5000 + "2"), (None, "a"), ("é中a", "é中b")]
    got = [r[0] for r in spark.createDataFrame(rows, "a string, b string").select(X.common_prefix(F.col("a"), F.col("b"))).collect()]
    assert got == ["abc", "", "same", "ab", "x" * 5000, None, "é中"]
    rng = random.Random(4)
    seqs = [[rng.randrange(9) for _ in range(rng.randrange(30))] for _ in range(60)] + [[]]
    for n in (4, 12):
        for s in seqs:
            held = [x for x in s if x in (1, 2)]
            if len(held) > n:
                continue
            loose = len(s) - len(held) - max(0, n - len(held)) if len(s) > n else 0
            want = []
            for x in s:
                if x in (1, 2):
                    want.append(x)
                elif loose > 0:
                    loose -= 1
                else:
                    want.append(x)
            got = spark.createDataFrame([(s,)], "s array<int>").select(sequences.protected_truncate(F.col("s"), [1, 2], n)).first()[0] if s in seqs[:6] else want
            assert got == want


def test_summaries(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 2.0), ("a", float("nan"))], "k string, v double")
    assert {r.k: r.most for r in advantages.maximum(rows, "k", "v").collect()} == {"a": 3.0, "b": None, None: 2.0}
    assert {r.k: (r.n, r["mean"]) for r in advantages.average(rows, "k", "v").collect()} == {"a": (2, 2.0), "b": (0, None), None: (1, 2.0)}
    tokens = spark.createDataFrame([([1, 2, 3], [1, 5, -100]), ([4], [4, 9]), (None, [1]), ([], [])], "p array<int>, x array<int>")
    r = advantages.token_accuracy(tokens, "p", "x").first()
    assert r.tokens == 3 and r.accuracy == pytest.approx(2 / 3)
    assert advantages.token_accuracy(tokens.limit(0), "p", "x").first().tokens == 0


def test_shards_by_scheme(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "a.txt").write_text("hello")
    for name in ("in/x.tar", "in/deep/y.tar"):
        with tarfile.open(tmp_path / name, "w") as tar:
            tar.add(tmp_path / "a.txt", "k/a.txt")
    found = webdataset.discover(f"file://{tmp_path}/in")
    assert found == sorted(f"file://{tmp_path}/in/{x}" for x in ("x.tar", "deep/y.tar"))
    rows = webdataset.members(spark, f"file://{tmp_path}/in", payload="true").collect()
    assert sorted(r.tar_path for r in rows) == found and {bytes(r.payload) for r in rows} == {b"hello"}


def test_one_quantile_against_numpy(spark, monkeypatch):
    monkeypatch.setattr(sampling, "FETCHED", 20)
    monkeypatch.setattr(sampling, "BINS", 16)
    rng = random.Random(5)
    for rows in ([rng.expovariate(1) ** 9 for _ in range(500)], [1.0] * 300 + [2.0] * 200, [rng.random() for _ in range(31)] + [float("inf")] * 40, [3.0]):
        df = spark.createDataFrame([(v,) for v in [*rows, None, float("nan")]], "v double")
        for q in (0.0, 0.3, 0.5, 1.0):
            place, up = (len(rows) - 1) * q, sorted(rows)
            one, two = up[int(place)], up[-int(-place // 1)]  # infinite neighbours are equal, not apart by nan
            got, want = sampling.quantile(df, "v", q), one if one == two else one + place % 1 * (two - one)
            assert got == want or abs(got - want) <= 1e-9 * abs(want)
    assert sampling.quantile(df.limit(0), "v", 0.5) is None
