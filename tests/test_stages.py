import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from grainmill import __main__ as stages
from grainmill.functions import sequences
from grainmill.operators import audit, conversation, judging, sampling
from grainmill.plans import preparation
from grainmill.sources import tabular


@pytest.fixture()
def shards(tmp_path):
    (tmp_path / "tars").mkdir()
    for s in range(2):
        with tarfile.open(tmp_path / "tars" / f"{s}.tar", "w") as tar:
            for k in range(5):
                for ending, data in (("txt", b"text"), ("json", json.dumps({"tagging_caption": "red cat, a dog, view"}).encode())):
                    info = tarfile.TarInfo(f"d/k{s}{k}.{ending}")
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
    return tmp_path


def test_stages(spark, shards):
    run, at = lambda *a: stages.main([str(x) for x in a]), lambda name: f"{shards}/{name}"
    run("index", at("tars"), at("index"), "--strip_folders")
    index = spark.read.parquet(at("index"))
    assert index.count() == 10 and {"sample_key", "tar_path", "priority"} <= set(index.columns)
    index.select("sample_key", F.lit(5.5).alias("aesthetic_score")).write.parquet(at("scores"))
    run("enrich", at("index"), at("scores"), at("scored"))
    assert spark.read.parquet(at("scored")).where("aesthetic_score = 5.5").count() == 10
    (shards / "keys.txt").write_text("k00\n\nk11\n")
    run("enrich", at("index"), at("keys.txt"), at("flagged"), "--flag", "clean")
    assert spark.read.parquet(at("flagged")).where("clean").count() == 2
    spark.createDataFrame([("n1", "cat"), ("n2", "dog"), ("n3", "view")], "node_id string, node_name string").write.parquet(at("concepts"))
    run("link", at("tars"), at("concepts"), at("links"))
    assert spark.read.parquet(at("links")).count() == 20
    run("rebalance", at("links"), at("index"), at("members"), "--reduction", "meaninv")
    (shards / "c.yaml").write_text("n_head: 2\nr_min: 0.3 # as a share\nboosts:\n  cat: 2\n")
    run("stratified", at("links"), at("chosen"), "--config", at("c.yaml"), "--r_min", "0.4")
    assert 0 < spark.read.parquet(at("chosen")).count() <= 10
    run("audit", at("links"), at("members/membership.parquet"), at("report"))
    report = tabular.parse_config(spark.read.text(at("report")).first()[0])
    assert report["distinct_samples"] == 10 and report["gini_before"] == 0


def test_configurations():
    assert stages.with_config(["s", "a", "--x", "1"], "x: 2\ny: true\nz: false\nw: null") == ["s", "--x", "2", "--y", "a", "--x", "1"]
    assert stages.with_config(["s"], None) == ["s"]
    pytest.importorskip("yaml")
    assert tabular.parse_config("a: 1\nboosts:\n  - node: x\n    by: 2\n") == {"a": 1, "boosts": [{"node": "x", "by": 2}]}


def test_groups_and_medians(spark):
    counts = spark.createDataFrame([("a", 1), ("b", 3), ("c", 5), ("d", 0)], "node_id string, N_c long")
    groups = spark.createDataFrame([("a", "g"), ("b", "g"), ("x", "h")], "node_id string, grp string")
    got = {r.grp: r for r in audit.group_composition(counts, groups).collect()}
    assert set(got) == {"g", "(none)"} and got["g"].links == 4 and got["g"].share == pytest.approx(4 / 9) and got["g"].top_share == 0.75 and got["g"].gini == pytest.approx(0.25)
    assert audit.group_composition(counts.limit(0), groups).count() == 0
    links = spark.createDataFrame([("s1", "a"), ("s2", "a"), ("s2", "b"), ("s3", "a"), ("s3", "b"), ("s3", "c"), ("s4", "a")], "sample_key string, node_id string")
    assert tuple(audit.nodes_per_sample(links).first()) == (4, 2) and tuple(audit.nodes_per_sample(links.limit(0)).first()) == (0, None)


def test_draws_and_modalities(spark):
    rows = spark.createDataFrame([(i, i if i % 4 else -i) for i in range(1, 40)], "id long, n long")
    drawn = sampling.sample_with_replacement(rows, "id", 100)
    assert drawn.count() == 100 and drawn.select("id").distinct().count() < 40 and sampling.sample_with_replacement(rows.limit(0), "id", 5).count() == 0
    out = sampling.modality_grouped(rows, "id", "n", 2, 2).collect()
    assert sorted(r.id for r in out) == list(range(1, 40)) and all(r.length == r.id for r in out)
    kinds = {m: {r.id % 4 == 0 for r in out if r.megabatch == m} for m in {r.megabatch for r in out}}
    assert sum(len(k) > 1 for k in kinds.values()) <= 1 and max(sum(r.megabatch == m for r in out) for m in kinds) == 4
    assert sampling.modality_grouped(rows.limit(0), "id", "n", 2, 2).count() == 0


def test_judges(spark):
    rows = spark.createDataFrame([(i, "long answer", "short") for i in range(20)] + [(20, None, "x")], "id long, a string, b string")
    longer = lambda x, y: F.when(F.length(x) > F.length(y), 0).when(x.isNotNull() & y.isNotNull(), 1)
    assert [r.winner for r in judging.pairwise(rows, "id", "a", "b", longer).orderBy("id").collect()] == [0] * 20 + [-1]
    first = judging.pairwise(rows, "id", "a", "b", lambda x, y: F.lit(0)).collect()
    assert {r.winner for r in first} == {0, 1}  # a bias for the first place is spread over both answers
    ranked = judging.rank(spark.createDataFrame([(["b", "aaa", None, "cc", "b"],), ([],), (None,)], "xs array<string>"), "xs", F.length).collect()
    assert [r.ranks for r in ranked] == [[2, 0, 4, 1, 3], [], None]


def test_text_prompts_and_merged_tokens(spark):
    pairs = spark.createDataFrame([("so be it", "so be at"), ("one a", "one b"), ("same", "same"), ("ab", "abc"), (None, "x"), ("", "x"), ("x", "y")], "chosen string, rejected string")
    got = [tuple(r) for r in conversation.maybe_extract_prompt(pairs).select("prompt", "chosen", "rejected").collect()]
    assert got == [("so be", " it", " at"), ("one", " a", " b"), ("sam", "e", "e"), ("a", "b", "bc"), ("", None, "x"), ("", "", "x"), ("", "x", "y")]
    split = spark.createDataFrame([([1, 2], [1, 2, 3]), ([1, 2], [1, 9, 3]), ([], [4])], "p array<int>, w array<int>").select(sequences.split_answer(F.col("p"), F.col("w")).alias("s")).collect()
    assert [(r.s.prompt, r.s.answer) for r in split] == [([1, 2], [3]), ([1], [9, 3]), ([], [4])]
    rows = spark.createDataFrame([("p q", " a", " bb")], "prompt string, chosen string, rejected string")
    row = preparation.reference_free(rows, lambda c: F.transform(F.split(c, " "), lambda w: F.length(w)), 7, 8).first()
    assert row.chosen_row.input_ids == [7, 1, 1, 1, 8] and row.chosen_row.labels == [-100, -100, -100, 1, 8] and row.rejected_row.input_ids[-2:] == [2, 8]


def test_quarantine(spark):
    good, bad = tabular.quarantine(spark.createDataFrame([(1,), (None,), (3,)], "x int"), F.col("x") > 2)
    assert [r.x for r in good.collect()] == [3] and {r.x for r in bad.collect()} == {1, None}
