import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from grainmill.functions import sequences, text as X
from grainmill.operators import conversation, judging, linking, sampling
from grainmill.plans import preparation, registry


def ids(c):
    """A stand-in for a tokenizer: lengths of words."""
    return F.transform(F.split(c, " "), lambda w: F.length(w))


U, A, B = ("user", "q one"), ("assistant", "a"), ("assistant", "bb cc")


@pytest.fixture()
def pairs(spark):
    return spark.createDataFrame([(1, [U, A], [U, B]), (2, [U, B], [U, A])], "id long, chosen array<struct<role:string,content:string>>, rejected array<struct<role:string,content:string>>")


def test_preparations(spark, pairs):
    row = preparation.preference(pairs, ids, 0, 2, 3).orderBy("id").first()
    assert len(row.prompt_input_ids) == 2 and len(row.chosen_input_ids) <= 3
    assert preparation.reward(pairs, ids, 1000).count() == 2 and preparation.reward(pairs, ids, 1).count() == 0
    out = preparation.unpaired(pairs.withColumn("batch", F.lit(0)), ids, "batch", "id").collect()
    assert len(out) == 4 and {r.label for r in out} == {True, False} and all(len(r.row.input_ids) == len(r.row.labels) for r in out)
    talks = pairs.select("id", F.col("chosen").alias("messages"))
    assert len(preparation.supervised(talks, ids, 2, "id").first().input_ids) == 2
    for pack in ("best_fit", "wrapped"):
        assert preparation.supervised(talks, ids, 64, "id", pack).count() >= 1
    with pytest.raises(ValueError):
        preparation.supervised(talks, ids, 64, "id", "other")
    steps = spark.createDataFrame([(1, "p", ["a b", "c"], [True, False])], "id long, prompt string, completions array<string>, labels array<boolean>")
    assert preparation.stepwise(steps, ids, 9, 99).first().labels == [-100, -100, -100, 1, -100, 0]


def test_template_of_pairs(pairs):
    row = conversation.apply_template(conversation.extract_prompt(pairs)).orderBy("id").first()
    assert row.prompt == "<|im_start|>user\nq one<|im_end|>\n<|im_start|>assistant\n" and row.chosen == "a<|im_end|>\n"


def test_registry(spark):
    @registry.reward("short")
    def _(c):
        return -F.length(c).cast("double")

    @registry.reward("nothing")
    def _(c):
        return F.lit(None).cast("double")

    df = spark.createDataFrame([("abc",)], "t string")
    assert registry.score(df, {"short": 2, "nothing": 1}, "t").first().reward == -6
    with pytest.raises(ValueError):
        registry.score(df, {"missing": 1}, "t")
    registry.reader("x")(lambda: df)
    assert registry.read("x").count() == 1
    with pytest.raises(ValueError):
        registry.read("y")


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    nested = F.array(F.array(F.lit(1), F.lit(5)), F.array(F.lit(1), F.lit(6)))
    assert one(sequences.image_splice(nested, 1)) == [1, 5, -200, 6]
    spans = F.array(*[F.struct(F.lit(n).alias("length"), F.lit(g).alias("generated")) for n, g in ((2, False), (1, True), (2, False))])
    r = one(sequences.dialogue_split(F.array(*map(F.lit, range(5))), spans))
    assert (r.query, r.response, r.mask) == ([0, 1], [2, 3, 4], [1, 0, 0])
    assert one(X.without_nulls(F.create_map(F.lit("a"), F.lit(None).cast("int"), F.lit("b"), F.lit(1)))) == {"b": 1}
    assert one(X.json_pick(F.lit('["a","b"]'), "string", F.lit(3))) in ("a", "b")
    assert one(X.json_pick(F.lit("[]"), "string", F.lit(3))) is None
    df = spark.createDataFrame([(("x", (1,)), 2)], "a struct<b:string,c:struct<d:int>>, e int")
    assert conversation.flatten(df).columns == ["a/b", "a/c/d", "e"]
    with pytest.raises(ValueError):
        conversation.flatten(df.withColumnRenamed("e", "e/f"))
    assert sampling.head_fraction(spark.range(100), 0.07, "id").count() == 7
    rows = spark.createDataFrame([("p", 0, 1.0, "a"), ("p", 1, 2.0, "b"), ("q", 0, 1.0, "c"), ("r", 0, 3.0, "d"), ("r", 1, 3.0, "e")], "p string, i int, s double, t string")
    assert {tuple(r) for r in judging.pick_pair(rows, "p", "i", "s", "t").collect()} == {("p", "b", "a"), ("r", "d", "e")}


def test_taxonomy(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("a", "x"), ("x", "d")], "child string, parent string")
    got = {(r.node_id, r.ancestor) for r in linking.ancestors(edges).collect()}
    assert {t for s, t in got if s == "a"} == set("abcdx") and {t for s, t in got if s == "d"} == {"d"}
    groups = spark.createDataFrame([("x",), ("c",)], "group_id string")
    assert {r.node_id: r.group_id for r in linking.primary_group(linking.ancestors(edges), groups).collect()} == {"a": "c", "b": "c", "c": "c", "x": "x"}
    concepts = spark.createDataFrame([(c,) for c in "abcdx"], "node_id string")
    linking.check_taxonomy(concepts, edges, "d")
    for bad in (("z", edges), ("d", edges.unionByName(spark.createDataFrame([("a", "zz")], "child string, parent string")))):
        with pytest.raises(ValueError):
            linking.check_taxonomy(concepts, bad[1], bad[0])


def test_rerank(spark):
    matches = spark.createDataFrame([("t", "n1", "a", 1.0), ("t", "n2", "b", 1.0), ("u", "n1", "a", 0.8)], "tag string, node_id string, node_name string, score double")
    tags = spark.createDataFrame([("t", [1.0, 0.0])], "tag string, vector array<float>")
    nodes = spark.createDataFrame([("n1", [1.0, 0.1]), ("n2", [0.0, 1.0])], "node_id string, vector array<float>")
    assert {(r.tag, r.node_id) for r in linking.rerank(matches, tags, nodes).collect()} == {("t", "n1"), ("u", "n1")}


def test_core_stands_alone():
    """Nothing outside the text subpackage imports it, but the entry point, which does without."""
    root = Path(__file__).resolve().parents[1]
    code = "import sys; sys.modules['grainmill.llm'] = None; import __spark_entry__ as e; assert len(e.queries()) > 60 and len(e.oracle_sql()) > 60 and not any(k[:2] == 'p1' for k in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    for f in (root / "grainmill").rglob("*.py"):
        if "llm" not in f.parts:
            assert "llm" not in f.read_text(), f
