import hashlib
import math

import pytest
from pyspark.sql import functions as F

from grainmill.functions import numeric, schedule, sequences, text as X
from grainmill.functions.hashing import draw, priority
from grainmill.plans.filter_language import compile_filter, where


def one(spark, column, **values):
    names = list(values)
    df = spark.createDataFrame([tuple(values.values())], names) if names else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_priority_is_sha256(spark):
    keys = [f"k{i}" for i in range(500)] + ["", "é"]
    rows = spark.createDataFrame([(k,) for k in keys], "k string").select("k", priority(F.col("k")).alias("p"), draw(F.col("k")).alias("h")).collect()
    for r in rows:
        p = int(hashlib.sha256(r.k.encode()).hexdigest(), 16) % 2**63
        assert r.p == p and r.h == p / 2**63 and 0 <= r.h <= 1
    assert one(spark, priority(F.lit(None).cast("string"))) is None


@pytest.mark.parametrize("m,h,count", [(0, 0.5, 0), (1, 0.0, 1), (1, 0.999999, 1), (2, 0.3, 2), (0.3, 0.29, 1), (0.3, 0.30, 0), (1.58, 0.57, 2), (1.58, 0.58, 1), (-1, 0.5, 0), (None, 0.5, 0)])
def test_realise(spark, m, h, count):
    assert one(spark, schedule.realise(F.lit(m).cast("double"), F.lit(h))) == count


@pytest.mark.parametrize("n,m", [(20000, 1), (50000, 1), (99999, 1), (1e7, 5 / 7), (8000, math.sqrt(2.5)), (1, 4), (0, 1), (None, 1)])
def test_schedule(spark, n, m):
    assert one(spark, schedule.concept_multiplicity(F.lit(n).cast("double"))) == pytest.approx(m)
    floor = schedule.Schedule(r_min=0.5)
    assert one(spark, schedule.concept_multiplicity(F.lit(1e30), floor)) == 0.5


@pytest.mark.parametrize("bad", [{"n_low": 0}, {"n_low": 2e5}, {"r_min": 1.1}, {"m_max": 0.5}, {"gamma": -1}])
def test_schedule_is_checked(bad):
    with pytest.raises(ValueError):
        schedule.Schedule(**bad)


def test_quota(spark):
    assert one(spark, schedule.stratum_quota(F.lit(5), F.lit(0.5))) == 2  # 2.5 to even
    assert one(spark, schedule.stratum_quota(F.lit(7), F.lit(0.0))) == 1
    assert one(spark, schedule.stratum_quota(F.lit(10), F.lit(0.9), boost=F.lit(0.5))) == 10


def test_filter_language(spark):
    rows = [("a", 0.1, True), ("b", 0.9, False), ("c", None, True), ("d", float("nan"), True), ("e", 0.9, None)]
    df = spark.createDataFrame(rows, "k string, s double, c boolean")
    keys = lambda e: [r.k for r in where(df, e).orderBy("k").collect()]
    assert keys("s > 0.5") == ["b", "e"]
    assert keys("s != 0.1") == ["b", "d", "e"]
    assert keys("s >= 0.1 and c == True") == ["a"]
    assert keys("k == 'c'") == ["c"]
    assert keys("") == keys(None) == list("abcde")
    for bad in ("s >", "s > 1 or s < 2", "nope > 1"):
        with pytest.raises(ValueError):
            compile_filter(bad, dict(df.dtypes))


def test_sequences(spark):
    a = F.array(*map(F.lit, [5, 6, 7, 8, 9]))
    assert one(spark, sequences.first_true(F.transform(a, lambda x: x == 7))) == 2
    assert one(spark, sequences.first_true(F.transform(a, lambda x: x == 1))) == 5
    assert one(spark, sequences.after_stop(a, 7)) == [5, 6, 7]
    assert one(spark, sequences.pad_after_stop(a, 7, 0)) == [5, 6, 7, 0, 0]
    assert one(spark, sequences.with_bos(a, 5)) == [5, 6, 7, 8, 9]
    assert one(spark, sequences.with_bos(a, 1))[0] == 1
    assert one(spark, sequences.with_eos_token(a, 2))[-1] == 2
    assert one(spark, sequences.padded(a, F.lit(7), 0, "left")) == [0, 0, 5, 6, 7, 8, 9]
    assert one(spark, sequences.position_ids(F.array(F.lit(3), F.lit(0), F.lit(2)))) == [0, 1, 2, 0, 1]
    assert one(spark, sequences.flushed(a, F.array(*map(F.lit, [0, 1, 0, 1, 1])))) == [6, 8, 9, 0, 0]
    assert one(spark, sequences.flushed(a, F.array(*map(F.lit, [1, 1, 0, 1, 0])), "right")) == [0, 0, 5, 6, 8]
    assert one(spark, sequences.shifted_right(a, 1)) == [1, 5, 6, 7, 8]
    assert one(spark, sequences.protected_truncate(a, [5, 6], 3)) == [5, 6, 9]
    with pytest.raises(Exception, match="protected"):
        one(spark, sequences.protected_truncate(a, [5, 6, 7], 2))
    row = one(spark, sequences.preference_row(a, a, a, 2, 2, 3))
    assert row.prompt == [8, 9] and row.chosen == [5, 6, 7]
    row = one(spark, sequences.answer_row(a, a, 6, 2))
    assert row.input_ids == [8, 9, 5, 6, 7, 8] and row.labels == [-100, -100, 5, 6, 7, 8]
    steps = F.array(F.array(F.lit(1), F.lit(2)), F.array(F.lit(3)))
    row = one(spark, sequences.stepwise_row(F.array(F.lit(9)), steps, F.array(F.lit(True), F.lit(False)), 0))
    assert row.input_ids == [9, 1, 2, 0, 3, 0] and row.labels == [-100, -100, -100, 1, -100, 0]
    assert one(spark, sequences.gae(F.array(F.lit(1.0), F.lit(2.0)), F.array(F.lit(0.5), F.lit(0.25)), 1.0, 0.5)) == pytest.approx([0.75 + 0.5 * 1.75, 1.75])


def test_numeric(spark):
    logits = F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))
    z = math.log(sum(map(math.exp, (1, 2, 3))))
    assert one(spark, numeric.log_softmax_at(logits, F.lit(1))) == pytest.approx(2 - z)
    p = [math.exp(x - z) for x in (1, 2, 3)]
    assert one(spark, numeric.entropy(logits)) == pytest.approx(-sum(x * math.log(x) for x in p))
    assert one(spark, numeric.jensen_shannon(logits, logits)) == pytest.approx(0, abs=1e-12)
    assert one(spark, numeric.logsigmoid(F.lit(-800.0))) == pytest.approx(-800)
    assert one(spark, numeric.softmax_pair(F.lit(0.0), F.lit(0.0))) == pytest.approx(0.5)


def test_text(spark):
    cap = lambda j: one(spark, X.caption(F.lit(j).cast("string"), "c", F.lit("txt")))
    assert [cap('{"c": "x"}'), cap('{"c": null}'), cap('{"d": 1}'), cap("no json"), cap(None)] == ["x", "", "txt", "txt", "txt"]
    assert one(spark, X.common_prefix(F.lit("abcd"), F.lit("abx"))) == "ab"
    assert one(spark, X.common_prefix(F.lit(""), F.lit("abx"))) == ""
    assert one(spark, X.common_prefix(F.lit("ab"), F.lit("abx"))) == "ab"
    assert one(spark, X.think_reward(F.lit("<think>\nx\n</think>y"))) == 1 and one(spark, X.think_reward(F.lit("<think>x<think></think>"))) == 0
    assert one(spark, X.edit_distance_reward(F.lit('draw "Stop"'), F.lit("s t o p!"))) == 1
    assert one(spark, X.edit_distance_reward(F.lit('draw "stop"'), F.lit("step"))) == pytest.approx(0.75)
    assert one(spark, X.edit_distance_reward(F.lit("nothing"), F.lit("x"))) is None
    assert one(spark, X.tool_call(F.lit("a <request><calc>1+1<call> b"))).asDict() == {"tool": "calc", "query": "1+1"}
    assert one(spark, X.tool_call(F.lit("none"))).tool is None
    turns = one(spark, X.dialogue_turns(F.lit("\n\nHuman: hi\n\nAssistant: yo")))
    assert [(t.role, t.content) for t in turns] == [("user", "hi"), ("assistant", "yo")]
    assert one(spark, X.control_reward(F.lit("[neutral]"), F.lit(-3.0))) == -2
    talk = one(spark, X.image_conversation(F.lit("I2I"), F.lit("x")))
    assert talk[0].content.startswith("<image>\n") and talk[1].content == ""
    for bad in (X.image_conversation(F.lit("V2V"), F.lit("x")), X.control_reward(F.lit("?"), F.lit(1.0))):
        with pytest.raises(Exception, match="unknown"):
            one(spark, bad)
    conv = F.from_json(F.lit('[{"from":"gpt","value":"a"},{"from":"human","value":"b"},{"from":"gpt","value":"c"}]'), "array<struct<from:string,value:string>>")
    assert [(t.role, t.content) for t in one(spark, X.chat_roles(conv, "s"))] == [("system", "s"), ("user", "b"), ("assistant", "c")]
    messages = X.to_chatml(conv)
    assert one(spark, X.render(messages, "single")) == "gpt: a\nhuman: b\ngpt: c\n"
    assert one(spark, X.render(messages, "two")) == "gpt: a\nhuman: b</s>gpt: c\n"
    assert one(spark, X.render(messages, "plain")) == "a\nb</s>c\n"
    with pytest.raises(ValueError):
        X.render(messages, "other")
