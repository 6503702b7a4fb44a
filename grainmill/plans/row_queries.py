"""Queries of the row-wise operators: text, tokens, converters, judges, numbers, trees and sources, with the SQL each must equal."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import shared_folder, table
from ..functions import numeric, sequences, text as X
from ..operators import advantages, catalog, conversation, judging, linking, rebalance, sampling
from ..sources import tabular, webdataset
from . import queries as base

QUERIES: dict = {}
SQL: dict[str, str] = {}
_MSG, _TOK, _SUM, _P = base._MSG, base._TOK, base._SUM, base._P
_digest, _messages, _events, _tokens, _r = base._digest, base._messages, base._events, base._tokens, base._r


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _quoted(values: list[str]) -> str:
    return ", ".join(f"'{v}'" for v in values)


# Catalogue and links


_INDEX = "i as (select sample_key, min(tar_path) tar_path, min(priority) priority, bool_or(is_clean) is_clean, max(case when isnan(aesthetic_score) then null else aesthetic_score end) score from sample_index where sample_key is not null group by 1)"


def _index(spark: SparkSession, d: str) -> DataFrame:
    score = F.nanvl("aesthetic_score", F.lit(None).cast("double"))
    rows = table(spark, d, "sample_index").where("sample_key is not null")
    return rows.groupBy("sample_key").agg(F.min("tar_path").alias("tar_path"), F.min("priority").alias("priority"), F.bool_or("is_clean").alias("is_clean"), F.max(score).alias("score"))


@query(f"with {base._SCORED}, i as (select sample_key, min(tar_path) tar_path from sample_index where sample_key is not null group by 1) select i.sample_key, tar_path, case when isnan(a) then null else a end as aesthetic_score, coalesce(isnan(a), false) as is_nan from i left join x using(sample_key)")
def enrich_known_scores(spark: SparkSession, d: str) -> DataFrame:
    """enrich_scores, with NaN told by a column of its own: comparisons of results take NaN for unequal to itself."""
    score = F.col("aesthetic_score")
    return base.enrich_scores(spark, d).withColumn("is_nan", F.coalesce(F.isnan(score), F.lit(False))).withColumn("aesthetic_score", F.nanvl(score, F.lit(None).cast("double")))


@query(f"with {_INDEX} select sample_key, tar_path, priority from i where score>5.0 order by priority, sample_key limit 200")
def materialise_select(spark: SparkSession, d: str) -> DataFrame:
    return catalog.materialise(_index(spark, d), "score > 5.0", 200, "select").select("sample_key", "tar_path", "priority")


@query("select (count(distinct sample_key)//256)::bigint as steps from sample_index")
def steps_of_an_epoch(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "sample_index").agg(F.count_distinct("sample_key")).first()[0]
    return spark.createDataFrame([(catalog.steps(n, 256),)], "steps long")


@query(f"""with {base._COPIES}, i as (select sample_key, min(tar_path) tar_path from sample_index where sample_key is not null group by 1)
 select sample_key, "count", tar_path from k join i using(sample_key) where "count">0""")
def membership_in_index(spark: SparkSession, d: str) -> DataFrame:
    index = catalog.index(table(spark, d, "sample_index"), "sample_key", "tar_path")
    return rebalance.membership(base._rarest(spark, d), index).select("sample_key", "count", "tar_path")


@query(f"""with {base._COPIES} select count(*)::bigint as missing, coalesce(sum("count"), 0)::bigint as copies from k where "count">0 and sample_key not in (select sample_key from sample_index where sample_key is not null)""")
def membership_missing(spark: SparkSession, d: str) -> DataFrame:
    """How many members the index lacks, which membership_in_index leaves out."""
    known = table(spark, d, "sample_index").select("sample_key").where("sample_key is not null")
    lost = base._copies(spark, d).join(known, "sample_key", "left_anti")
    return lost.agg(F.count(F.lit(1)).alias("missing"), F.coalesce(F.sum("count"), F.lit(0)).alias("copies"))


@query(f"""with {base._NAMED}, b as (select base from d where node_name is not null group by 1 having count(*)>1 and max(n)>=100)
 select node_id, 'mislink' as reason from d where node_id in ({_quoted(rebalance.CONFIRMED_MISLINKS)}) union all select node_id, 'split form' from d join b using(base) where n<100""")
def excluded_nodes(spark: SparkSession, d: str) -> DataFrame:
    return rebalance.excluded_nodes(base._named_counts(spark, d), 100)


_ENDED = ["", " view", " views", " scenery", "view"]
_ABSTRACT = f"(lower(trim(tag)) in ({_quoted(linking.ABSTRACT_TAGS)}) or regexp_matches(lower(trim(tag)), ' ({'|'.join(linking.ABSTRACT_ENDINGS)})$'))"


@query(f"""with t as (select node_id, e as ending, node_name || e as tag from concepts, (select unnest([{_quoted(_ENDED)}]) e) where node_name is not null
 union all select a, 'list', a from (select unnest([{_quoted(linking.ABSTRACT_TAGS)}, ' Scene ', 'cat']) a))
 select node_id, ending, tag, {_ABSTRACT} as abstract_tag, lower(trim(tag)) in ({_quoted(linking.ABSTRACT_NODES)}) as abstract_node from t""")
def abstract_names(spark: SparkSession, d: str) -> DataFrame:
    endings = F.explode(F.array(*[F.lit(e) for e in _ENDED]))
    named = table(spark, d, "concepts").where("node_name is not null").select("node_id", "node_name", endings.alias("ending")).select("node_id", "ending", F.concat("node_name", "ending").alias("tag"))
    fixed = spark.createDataFrame([(a, "list", a) for a in [*linking.ABSTRACT_TAGS, " Scene ", "cat"]], "node_id string, ending string, tag string")
    tags = named.unionByName(fixed)
    return tags.withColumns({"abstract_tag": linking.is_abstract_tag(F.col("tag")), "abstract_node": linking.is_abstract_node(F.col("tag"))})


@query(f"""with t as (select node_id, lower(node_name) nm from concepts where node_name is not null),
 g as (select node_id, unnest(list_distinct(list_filter([nm, nm||' view', 'cat '||nm, nm], lambda x: not (x in ({_quoted(linking.ABSTRACT_TAGS)}) or regexp_matches(x, ' ({'|'.join(linking.ABSTRACT_ENDINGS)})$'))))) tag from (select node_id, trim(regexp_replace(nm, '\\s+', ' ', 'g')) nm from t)) select node_id, tag from g where tag <> ''""")
def parsed_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tag texts with lettering in quotes, counts, numbers, repeats and abstract descriptors, made of each concept's name."""
    rows = table(spark, d, "concepts").where("node_name is not null")
    name = F.col("node_name")
    text = F.concat(F.upper(name), F.lit(', "quoted '), name, F.lit('", 3  '), name, F.lit(", 12, 4.5, "), name, F.lit(" view,scene, cat  "), name, F.lit(",, "), name)
    return rows.select("node_id", F.explode(linking.parse_tags(text)).alias("tag"))


_TREE = """e as (select 'n'||n_nationkey as child, 'r'||n_regionkey as parent from nation union all select 'r'||r_regionkey, 'root' from region union all select 'c'||c_custkey, 'n'||c_nationkey from customer)"""


def _edges(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda t, a, x, b, y: table(spark, d, t).select(F.concat(F.lit(a), F.col(x).cast("string")).alias("child"), (F.concat(F.lit(b), F.col(y).cast("string")) if y else F.lit(b)).alias("parent"))
    return pair("nation", "n", "n_nationkey", "r", "n_regionkey").unionByName(pair("region", "r", "r_regionkey", "root", None)).unionByName(pair("customer", "c", "c_custkey", "n", "c_nationkey"))


@query(f"with recursive {_TREE}, a as (select child as node_id, child as ancestor from e union select parent, parent from e union select a.node_id, e.parent from a join e on a.ancestor = e.child) select node_id, ancestor from a")
def taxonomy_closure(spark: SparkSession, d: str) -> DataFrame:
    edges = _edges(spark, d)
    concepts = edges.select(F.col("child").alias("node_id")).unionByName(edges.select(F.col("parent").alias("node_id"))).distinct()
    linking.check_taxonomy(concepts, edges, "root")
    return linking.ancestors(edges)


@query("select 'c'||c_custkey as node_id, 'r'||n_regionkey as group_id from customer join nation on c_nationkey=n_nationkey union all select 'n'||n_nationkey, 'r'||n_regionkey from nation union all select 'r'||r_regionkey, 'r'||r_regionkey from region")
def taxonomy_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("group_id"))
    return linking.primary_group(linking.ancestors(_edges(spark, d)), groups)


# Conversations


_CONV = f"{_MSG}, t as (select conv_id, list(struct_pack(r := \"role\", c := content) order by turn_idx, message_id) l from g where conv_id is not null group by 1)"


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    return conversation.conversations(_messages(spark, d))


def _shown(turns) -> F.Column:
    """Turns as text, to be compared."""
    return F.array_join(F.transform(turns, lambda x: F.concat(F.coalesce(x["role"], F.lit("?")), F.lit(":"), F.coalesce(x["content"], F.lit("~")))), "|")


def _sql_shown(turns: str) -> str:
    return f"array_to_string(list_transform({turns}, lambda x: coalesce(x.r,'?')||':'||coalesce(x.c,'~')), '|')"


@query(f"with {_CONV}, k as (select conv_id, case when l[1].r <> 'user' then l[2:] else l end l from t) select conv_id, 'system:be kind'||case when len(l)>0 then '|' else '' end||{_sql_shown('l')} as turns from k")
def chat_roles(spark: SparkSession, d: str) -> DataFrame:
    name = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    turns = F.transform("messages", lambda m: F.struct(name(m["role"]).alias("from"), m["content"].alias("value")))
    return _conversations(spark, d).select("conv_id", _shown(X.chat_roles(turns, "be kind")).alias("turns"))


@query(f"with {_CONV} select conv_id, {_sql_shown('l')} as turns from t")
def to_chatml(spark: SparkSession, d: str) -> DataFrame:
    turns = F.transform("messages", lambda m: F.struct(m["role"].alias("from"), m["content"].alias("value")))
    return conversation.to_chatml(_conversations(spark, d).select("conv_id", turns.alias("conversations"))).select("conv_id", _shown(F.col("messages")).alias("turns"))


_PART = "list_transform(l, lambda x, i: {x})"


@query(f"""with {_CONV} select conv_id, 'S'||array_to_string({_PART.format(x="x.r||': '||coalesce(x.c,'')||chr(10)")}, '') as single,
 array_to_string({_PART.format(x="x.r||': '||coalesce(x.c,'')||case when i%2=1 then '#' else '</s>' end")}, '') as two, array_to_string({_PART.format(x="coalesce(x.c,'')||case when i%2=1 then '#' else '</s>' end")}, '') as plain from t""")
def render_styles(spark: SparkSession, d: str) -> DataFrame:
    m, seps = F.col("messages"), ("#", "</s>")
    return _conversations(spark, d).select("conv_id", X.render(m, "single", "S").alias("single"), X.render(m, "two", seps=seps).alias("two"), X.render(m, "plain", seps=seps).alias("plain"))


_IM = "array_to_string(list_transform({l}, lambda x: '<|im_start|>'||x.r||chr(10)||coalesce(x.c,'')||'<|im_end|>'||chr(10)), '')"


@query(f"""with {_CONV} select conv_id, {_IM.format(l="list_filter(l, lambda x: x.r='user')[1:1]")}||'<|im_start|>assistant'||chr(10) as prompt,
 '<|im_start|>assistant'||chr(10)||'so'||'<|im_end|>'||chr(10) as rest, substr({_IM.format(l="list_filter(l, lambda x: x.r='assistant')[1:1]")}, 1, length({_IM.format(l="list_filter(l, lambda x: x.r='assistant')[1:1]")})-11) as left_open
 from t where len(list_filter(l, lambda x: x.r='user'))>0 and len(list_filter(l, lambda x: x.r='assistant'))>0""")
def generation_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A conversation's first question asks for its answer; its first answer is left open to go on. (Others have no prompt.)"""
    of = lambda r: F.slice(F.filter("messages", lambda m: m["role"] == r), 1, 1)
    rows = _conversations(spark, d).select("conv_id", of("user").alias("prompt"), of("assistant").alias("said")).where((F.size("prompt") > 0) & (F.size("said") > 0))
    rows = rows.withColumn("completion", F.array(X.turn("assistant", F.lit("so"))))
    done = conversation.apply_template(rows)
    rest = F.concat(F.lit("<|im_start|>assistant\n"), "completion")
    return done.select("conv_id", "prompt", rest.alias("rest"), X.with_generation_prompt(X.render(F.col("said")), F.col("said")).alias("left_open"))


_SIDES = """p as (select pref_id, list_transform(coalesce(chosen,[]), lambda x: struct_pack(r := x."role", c := x.content)) c, list_transform(coalesce(rejected,[]), lambda x: struct_pack(r := x."role", c := x.content)) r from preferences),
 q as (select *, least(len(c),len(r)) n from p), z as (select *, coalesce(list_min(list_filter(range(n), lambda i: c[i+1] is distinct from r[i+1])), greatest(n-1,0)) k from q)"""


@query(f"with {_SIDES} select pref_id, {_sql_shown('c[1:k]')} as prompt, {_sql_shown('c[k+1:]')} as chosen, {_sql_shown('r[k+1:]')} as rejected from z")
def extracted_prompts(spark: SparkSession, d: str) -> DataFrame:
    empty = F.expr("cast(array() as array<struct<role:string,content:string>>)")
    pairs = table(spark, d, "preferences").select("pref_id", F.coalesce("chosen", empty).alias("chosen"), F.coalesce("rejected", empty).alias("rejected"))
    out = conversation.maybe_extract_prompt(pairs)
    return out.select("pref_id", *[_shown(F.col(c)).alias(c) for c in ("prompt", "chosen", "rejected")])


_LASTS = "s as (select pref_id, chosen[-1].content a, rejected[-1].content b from preferences)"


def _lasts(spark: SparkSession, d: str) -> DataFrame:
    last = lambda c: F.try_element_at(c, F.lit(-1))["content"]
    return table(spark, d, "preferences").select("pref_id", last("chosen").alias("a"), last("rejected").alias("b"))


@query(f"with {_LASTS}, n as (select *, coalesce(list_min(list_filter(range(1, least(length(a),length(b))+1), lambda i: a[i]<>b[i]))-1, least(length(a),length(b))) k from s) select pref_id, case when b is not null then substr(a, 1, k) end as prefix from n")
def common_prefixes(spark: SparkSession, d: str) -> DataFrame:
    return _lasts(spark, d).select("pref_id", X.common_prefix(F.col("a"), F.col("b")).alias("prefix"))


@query(f"""with {_LASTS}, n as (select pref_id, replace(lower(string_split('read "'||coalesce(a,'')||'"', '"')[2]),' ','') t, replace(lower(coalesce(b,'')),' ','') b from s)
 select pref_id, case when length(t)>0 then case when contains(b,t) then 1.0 else round(1-least(levenshtein(t,b),length(t))/length(t),6) end end as reward from n""")
def edit_distance_rewards(spark: SparkSession, d: str) -> DataFrame:
    """Every pair: a target is what stands between the first two quotes, so that of a text with quotes ends at its first."""
    rows = _lasts(spark, d).withColumn("p", F.concat(F.lit('read "'), F.coalesce("a", F.lit("")), F.lit('"')))
    return rows.select("pref_id", _r(X.edit_distance_reward(F.col("p"), F.col("b"))).alias("reward"))


_MARKS = "list_transform(list_filter(l, lambda x: x.r in ('user','assistant')), lambda x: struct_pack(r := x.r, c := trim(coalesce(x.c,''))))"


def _transcripts(spark: SparkSession, d: str) -> DataFrame:
    name = lambda r: F.when(r == "user", "Human").otherwise("Assistant")
    said = F.filter("messages", lambda m: m["role"].isin("user", "assistant"))
    text = F.array_join(F.transform(said, lambda m: F.concat(F.lit("\n\n"), name(m["role"]), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "")
    return _conversations(spark, d).select("conv_id", text.alias("text"))


@query(f"with {_CONV} select conv_id, {_sql_shown(_MARKS)} as turns from t")
def dialogue_turns(spark: SparkSession, d: str) -> DataFrame:
    return _transcripts(spark, d).select("conv_id", _shown(X.dialogue_turns(F.col("text"))).alias("turns"))


@query(f"with {_CONV} select conv_id, {_sql_shown(_MARKS)} as prompt, 'assistant:yes' as chosen, 'assistant:no' as rejected from t")
def transcripts_to_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _transcripts(spark, d)
    pairs = rows.select("conv_id", *[F.concat("text", F.lit(f"\n\nAssistant: {w}")).alias(c) for c, w in (("chosen", "yes"), ("rejected", "no"))])
    return conversation.from_transcripts(pairs).select("conv_id", *[_shown(F.col(c)).alias(c) for c in ("prompt", "chosen", "rejected")])


@query("select 'SUBREDDIT: r/'||source||chr(10)||chr(10)||'TITLE: '||site||chr(10)||chr(10)||'POST: '||text||chr(10)||chr(10)||'TL;DR:' as prompt, ' '||trim(lang) as completion from documents")
def posts_to_prompts(spark: SparkSession, d: str) -> DataFrame:
    return conversation.from_posts(table(spark, d, "documents").select(F.col("source").alias("subreddit"), F.col("site").alias("title"), F.col("text").alias("post"), F.col("lang").alias("summary")))


@query(f"with {_LASTS} select 'Question: '||pref_id||chr(10)||chr(10)||'Answer: ' as prompt, a as chosen, b as rejected from s")
def questions_to_pairs(spark: SparkSession, d: str) -> DataFrame:
    return conversation.from_questions(_lasts(spark, d).select(F.col("pref_id").cast("string").alias("question"), F.col("a").alias("response_j"), F.col("b").alias("response_k")))


@query("select event_type||event_id as prompt, user_id::varchar as completion, (event_id%9)>=5 as label from events where event_type<>'error'")
def rated_answers(spark: SparkSession, d: str) -> DataFrame:
    answer = lambda c, r: F.struct(c.cast("string").alias("response"), r.cast("string").alias("rating"))
    models = F.when(F.col("event_type") == "error", F.array(F.lit("m1"), F.lit("m3"))).otherwise(F.array(F.lit("m1"), F.lit("m2")))
    rows = _events(spark, d).select(F.concat("event_type", F.col("event_id").cast("string")).alias("instruction"), models.alias("models"), F.array(answer(F.col("event_id"), F.lit(1)), answer(F.col("user_id"), F.col("event_id") % 9)).alias("completions"))
    return conversation.from_ratings(rows, "m2")


@query("""with s as (select event_id, [event_type, (event_id%2)::varchar, event_type, (user_id%2)::varchar] x from (select event_id, user_id, (event_id%2)::varchar event_type from events))
 select event_id::varchar as prompt, x[event_id%4+1] as chosen, list_filter(x, lambda v: v<>x[event_id%4+1])[1] as rejected from s where not (x[1]=x[2] and x[1]=x[3] and x[1]=x[4])""")
def four_samples(spark: SparkSession, d: str) -> DataFrame:
    two = lambda c: (F.col(c) % 2).cast("string")
    rows = _events(spark, d).select(F.col("event_id").cast("string").alias("query"), (F.col("event_id") % 4).cast("int").alias("best"), two("event_id").alias("sample0"), two("event_id").alias("sample1"), two("event_id").alias("sample2"), two("user_id").alias("sample3"))
    return conversation.from_four(rows)


@query("select 'Q'||event_id as prompt, 'Step 1: a'||user_id||'|Step 2: b' as completions, 'true|'||case when event_id%2=0 then 'true' else 'false' end as labels from events")
def marked_steps(spark: SparkSession, d: str) -> DataFrame:
    q, u = F.concat(F.lit("Q"), F.col("event_id").cast("string")), F.col("user_id").cast("string")
    rows = _events(spark, d).select(
        F.concat(q, F.lit(" Step 1: a"), u, F.lit(" ки\nStep 2: b ки")).alias("input"), F.concat(q, F.lit(" Step 1: a"), u, F.lit(" +\nStep 2: b "), F.when(F.col("event_id") % 2 == 0, "+").otherwise("-")).alias("label")
    )
    return conversation.from_marked_steps(rows).select("prompt", F.array_join("completions", "|").alias("completions"), F.array_join(F.transform("labels", lambda x: x.cast("string")), "|").alias("labels"))


@query("""select event_id::varchar as prompt, 'b' as completions, 'false' as labels from events union all select event_id::varchar, 'a'||user_id||'|c', 'true|'||(event_id%2=1) from events
 union all select event_id::varchar, 'a'||user_id||'|d', 'true|true' from events""")
def step_trees(spark: SparkSession, d: str) -> DataFrame:
    c = lambda text, rating: F.struct(text.alias("text"), rating.cast("int").alias("rating"))
    a = F.concat(F.lit("a"), F.col("user_id").cast("string"))
    step = lambda chosen, *cs: F.struct(F.array(*cs).alias("completions"), F.lit(chosen).alias("chosen"))
    steps = F.array(step(0, c(a, F.lit(1)), c(F.lit("b"), F.lit(-1))), step(1, c(F.lit("c"), F.col("event_id") % 2), c(F.lit("d"), F.lit(1))))
    out = conversation.from_step_tree(_events(spark, d).select(F.col("event_id").cast("string").alias("problem"), steps.alias("steps")))
    return out.select("prompt", F.array_join("completions", "|").alias("completions"), F.array_join(F.transform("labels", lambda x: x.cast("string")), "|").alias("labels"))


@query(f"""with {_LASTS} select pref_id, '<|im_start|>user'||chr(10)||coalesce(a,'')||'<|im_end|>'||chr(10)||'<|im_start|>assistant'||chr(10)||coalesce(b,'')||'<|im_end|>'||chr(10) as formatted from s""")
def formatted_pairs(spark: SparkSession, d: str) -> DataFrame:
    return conversation.format_text(_lasts(spark, d).withColumnsRenamed({"a": "prompt", "b": "completion"})).select("pref_id", "formatted")


@query('select o_orderkey as "key", o_orderstatus as "state/name", o_totalprice as "state/price/total" from orders')
def flattened(spark: SparkSession, d: str) -> DataFrame:
    price = F.struct(F.col("o_totalprice").alias("total"))
    return conversation.flatten(table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.struct(F.col("o_orderstatus").alias("name"), price.alias("price")).alias("state")))


@query(f"with {_MSG} select message_id, case when \"role\"='assistant' then replace(content,'a','<im_start>a<im_end>') else content end as said, (content is not null)::int+(author_id is not null)::int as held, case when content is not null then 'x'||\"role\" end as picked from g")
def field_functions(spark: SparkSession, d: str) -> DataFrame:
    """Image marks in answers, maps without nulls, and a pick from a JSON list (of equal elements, so that any will do)."""
    speaker = F.when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    turns = X.image_token_turns(F.array(F.struct(speaker.alias("from"), F.col("content").alias("value"))), token="a")
    fields = F.create_map(F.lit("c"), F.col("content"), F.lit("a"), F.col("author_id").cast("string"))
    items = F.when(F.col("content").isNotNull(), F.concat(F.lit('["x'), "role", F.lit('", "x'), "role", F.lit('"]'))).otherwise("[]")
    return _messages(spark, d).select("message_id", F.get(turns, F.lit(0))["value"].alias("said"), F.size(X.without_nulls(fields)).alias("held"), X.json_pick(items, "string", F.col("message_id")).alias("picked"))


@query(f"""with {_MSG}, c as (select message_id, '<request><'||"role"||'>'||replace(content,'<','(')||'<call>' x from g where content is not null)
 select message_id, nullif(regexp_extract(x, '(?s)<(\\w+)>', 1, 's'), '') as tool_0, regexp_extract(x, '<request><(\\w+)>', 1) as tool, nullif(regexp_extract(x, '(?s)<request><\\w+>(.*?)<call>', 1), '') as query from c""")
def tool_calls(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("<request><"), "role", F.lit(">"), F.replace("content", F.lit("<"), F.lit("(")), F.lit("<call>"))
    call = X.tool_call(text)
    rows = _messages(spark, d).where("content is not null").select("message_id", call.alias("c"))
    return rows.select("message_id", F.lit("request").alias("tool_0"), "c.tool", "c.query")


# Rewards, judges, numbers


@query("select event_id, case event_id%3 when 0 then -value when 1 then -2*abs(value)+4 else value end as control, (lower(event_type)=lower(trim(event_type)))::int::double as answer from events")
def control_and_answer_rewards(spark: SparkSession, d: str) -> DataFrame:
    token = F.when(F.col("event_id") % 3 == 0, "[negative]").when(F.col("event_id") % 3 == 1, "[neutral]").otherwise("[positive]")
    answer = X.answer_reward(F.concat(F.lit(" "), F.upper("event_type"), F.lit("  ")), F.col("event_type"))
    return _events(spark, d).select("event_id", X.control_reward(token, F.col("value")).alias("control"), answer.alias("answer"))


@query("with m as (select avg(value) m, stddev_samp(value) s from events) select event_id, round(greatest(-1.0, least(1.0, (value-m)/(s+1e-8))),6) as normalised from events, m")
def normalised_rewards(spark: SparkSession, d: str) -> DataFrame:
    return advantages.normalised_rewards(_events(spark, d), "value", 1.0).select("event_id", _r("normalised").alias("normalised"))


@query("""with p as (select event_id//2 as prompt, max(case when event_id%2=0 then value end) a, max(case when event_id%2=1 then value end) b, max(case when event_id%2=0 then event_id end) i, max(case when event_id%2=1 then event_id end) j from events group by 1)
 select prompt, case when a>=b then i else j end as chosen, case when a>=b then j else i end as rejected from p where a is not null and b is not null""")
def pick_pairs(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select(F.expr("event_id div 2").alias("prompt"), (F.col("event_id") % 2).alias("place"), "value", "event_id")
    return judging.pick_pair(rows, "prompt", "place", "value", "event_id")


@query("""select event_id, case when event_id%5=0 then -1 when event_id%2=1 then 1-(event_id%3)%2 else (event_id%3)%2 end::int as ranked, (case when value/100>0.5 then 0 else 1 end)::int as soft,
 (case when event_id%7=0 then -1 when event_id%2=1 and event_id%3=1 then 1 else 0 end)::int as every from events""")
def judge_votes(spark: SparkSession, d: str) -> DataFrame:
    e = F.col("event_id")
    rank = F.when(e % 5 == 0, -1).otherwise((e % 3) % 2).cast("int")
    votes = F.array((e % 2).cast("int"), F.when(e % 3 == 1, 1).otherwise(0), F.when(e % 7 == 0, -1).otherwise(1))
    return _events(spark, d).select("event_id", judging.unflipped(rank, e % 2 == 1).cast("int").alias("ranked"), judging.soft_winner(F.col("value") / 100).cast("int").alias("soft"), judging.all_true(votes).cast("int").alias("every"))


_VEC = "e as (select vec_id, embedding::double[] v, list_transform(embedding, lambda x: -0.5*x::double) w from embeddings where embedding is not null)"
_LSE = "(list_max({v})+ln(list_sum(list_transform({v}, lambda x: exp(x-list_max({v}))))))"
_ZIP = "list_sum(list_transform(range(1, len(v)+1), lambda i: {x}))"


@query(f"""with {_VEC}, z as (select *, {_LSE.format(v='v')} a, {_LSE.format(v='w')} b from e), l as (select vec_id, v, w, a, b, list_transform(v, lambda x: x-a) p, list_transform(w, lambda x: x-b) q from z)
 select vec_id, round(a,6) as normaliser, round(v[3]-a,6) as third, round({_ZIP.format(x='-exp(p[i])*p[i]')},6) as entropy, round({_ZIP.format(x='exp(q[i])*(q[i]-p[i])')},6) as forward,
 round(0.5*{_ZIP.format(x='exp(q[i])*(q[i]-ln(0.5*exp(p[i])+0.5*exp(q[i])))')}+0.5*{_ZIP.format(x='exp(p[i])*(p[i]-ln(0.5*exp(p[i])+0.5*exp(q[i])))')},6) as middle from l""")
def logit_functions(spark: SparkSession, d: str) -> DataFrame:
    v, w = F.transform("embedding", lambda x: x.cast("double")), F.transform("embedding", lambda x: x.cast("double") * -0.5)
    rows = table(spark, d, "embeddings").where("embedding is not null").select("vec_id", v.alias("v"), w.alias("w"))
    one, two = F.col("v"), F.col("w")
    return rows.select("vec_id", _r(numeric.logsumexp(one)).alias("normaliser"), _r(numeric.log_softmax_at(one, F.lit(2))).alias("third"), _r(numeric.entropy(one)).alias("entropy"), _r(numeric.jensen_shannon(one, two, 0.0)).alias("forward"), _r(numeric.jensen_shannon(one, two)).alias("middle"))


@query("select event_type, round(max(value),6) as most, count(value)::bigint as n, round(avg(value),6) as mean from events group by 1")
def averages_and_maxima(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d)
    return advantages.maximum(rows, "event_type", "value").withColumn("most", _r("most")).join(advantages.average(rows, "event_type", "value").withColumn("mean", _r("mean")), "event_type")


@query(f"with {_TOK}, s as (select list_transform(tokens, lambda v: v%5) p, list_transform(tokens, lambda v: case when v>9 then -100 else v%3 end) x from t), n as (select len(list_filter(x, lambda v: v<>-100)) n, len(list_filter(range(1,len(x)+1), lambda i: x[i]<>-100 and x[i]=p[i])) h from s) select round(sum(h)/sum(n),8) as accuracy, sum(n)::bigint as tokens from n")
def token_accuracy(spark: SparkSession, d: str) -> DataFrame:
    rows = _tokens(spark, d).select(F.transform("tokens", lambda v: v % 5).alias("p"), F.transform("tokens", lambda v: F.when(v > 9, -100).otherwise(v % 3)).alias("x"))
    return advantages.token_accuracy(rows, "p", "x").withColumn("accuracy", _r("accuracy", 8))


# Token sequences


def _sql_digest(x: str) -> str:
    return f"coalesce({_SUM.format(x=x)}, 0)"


@query(f"""with {_TOK}, s as (select doc_id, tokens t, len(tokens) n, coalesce(list_position(tokens,7),0) stop_at from t)
 select doc_id, {_sql_digest('case when t[1]=3 then t else list_concat([3], t) end')} as bos, {_sql_digest('case when t[-1]=4 then t else list_concat(t, [4]) end')} as eos, {_sql_digest('list_concat([9], t[1:n-1])')} as shifted,
 {_sql_digest('case when n>5 then t[n-4:] else t end')} as tail, {_sql_digest('list_transform(t, lambda v, i: case when stop_at>0 and i>stop_at then 0 else v end)')} as padded, {_sql_digest('list_filter(t, lambda v: v>4)')} as kept, len(list_filter(t, lambda v: v>4))::int as n_kept from s""")
def sequence_edges(spark: SparkSession, d: str) -> DataFrame:
    """Start and end tokens, shift, last tokens, padding after a stop, and flushing (rows with nothing kept too)."""
    t = F.col("tokens")
    mask = F.transform(t, lambda v: (v > 4).cast("int"))
    columns = {"bos": sequences.with_bos(t, 3), "eos": sequences.with_eos_token(t, 4), "shifted": sequences.shifted_right(t, 9), "tail": sequences.last(t, 5), "padded": sequences.pad_after_stop(t, 7, 0), "kept": sequences.flushed(t, mask)}
    return _tokens(spark, d).select("doc_id", *[_digest(c).alias(k) for k, c in columns.items()], F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("n_kept"))


_ROWS = f"{_TOK}, s as (select doc_id, tokens[1:len(tokens)//2] p, tokens[len(tokens)//2+1:] a from t)"


def _halves(spark: SparkSession, d: str) -> DataFrame:
    half = F.expr("int(size(tokens) div 2)")
    return _tokens(spark, d).select("doc_id", F.slice("tokens", F.lit(1), half).alias("p"), F.slice("tokens", half + 1, F.greatest(F.size("tokens"), F.lit(1))).alias("a"))


@query(f"""with {_ROWS}, k as (select doc_id, p, a, case when len(p)+len(a)>60 and len(p)>20 then p[len(p)-19:] else p end q from s), x as (select *, a[1:greatest(60-len(q),0)] b, list_concat(a,[2])[1:30] c, list_concat(p,[2])[1:30] r, case when len(p)>20 then p[len(p)-19:] else p end l from k)
 select doc_id, {_sql_digest('list_concat(q,b)')} as ids, {_sql_digest('list_concat(list_transform(q, lambda v: -100), b)')} as labels, {_sql_digest('l')} as prompt, {_sql_digest('c')} as chosen, {_sql_digest('r')} as rejected from x""")
def training_rows(spark: SparkSession, d: str) -> DataFrame:
    p, a = F.col("p"), F.col("a")
    rows = _halves(spark, d).select("doc_id", sequences.answer_row(p, a, 60, 20).alias("x"), sequences.preference_row(p, a, p, 2, 20, 30).alias("y"))
    return rows.select("doc_id", _digest(F.col("x.input_ids")).alias("ids"), _digest(F.col("x.labels")).alias("labels"), *[_digest(F.col(f"y.{c}")).alias(c) for c in ("prompt", "chosen", "rejected")])


@query(f"""with {_ROWS} select doc_id, {_sql_digest('list_concat([5,6], p, [1], a, [1])')} as ids, {_sql_digest('list_concat([-100,-100], list_transform(p, lambda v: -100), [case when doc_id%2=0 then 1 else 0 end], list_transform(a, lambda v: -100), [1])')} as labels,
 {_sql_digest('list_concat([-100,-100], list_transform(p, lambda v: -100), [-100], list_transform(a, lambda v: -100), [1])')} as last_labels from s""")
def stepwise_rows(spark: SparkSession, d: str) -> DataFrame:
    prompt, steps, flags = F.array(F.lit(5), F.lit(6)), F.array("p", "a"), F.array(F.col("doc_id") % 2 == 0, F.lit(True))
    rows = _halves(spark, d).select("doc_id", sequences.stepwise_row(prompt, steps, flags, 1).alias("x"), sequences.stepwise_row(prompt, steps, flags, 1, True).alias("y"))
    return rows.select("doc_id", _digest(F.col("x.input_ids")).alias("ids"), _digest(F.col("x.labels")).alias("labels"), _digest(F.col("y.labels")).alias("last_labels"))


@query(f"""with {_TOK}, h as (select doc_id, case when len(list_filter(tokens, lambda v: v in (12,13)))>40 then tokens[1:40] else tokens end t from t), g as (select doc_id, t, list_filter(range(1,len(t)+1), lambda i: t[i] not in (12,13)) o, 40-len(list_filter(t, lambda v: v in (12,13))) room from h),
 f as (select *, case when len(t)<=40 then 0 when room<=0 then 1000000000 else o[len(o)-room+1] end first from g) select doc_id, {_sql_digest('list_transform(list_filter(range(1,len(t)+1), lambda i: t[i] in (12,13) or i>=first), lambda i: t[i])')} as digest from f""")
def protected_truncation(spark: SparkSession, d: str) -> DataFrame:
    many = F.size(F.filter("tokens", lambda v: v.isin(12, 13))) > 40  # protected tokens that alone are too many are an error
    t = F.when(many, F.slice("tokens", 1, 40)).otherwise(F.col("tokens"))
    return _tokens(spark, d).select("doc_id", t.alias("t")).select("doc_id", _digest(sequences.protected_truncate(F.col("t"), [12, 13], 40)).alias("digest"))


@query(f"""with {_ROWS} select doc_id, {_sql_digest('list_concat([1], p, [-200], a)')} as spliced, {_sql_digest('p')} as query, {_sql_digest('list_concat(a,[8,9])')} as response,
 {_sql_digest('list_concat(list_transform(a, lambda v: 1), [0,0])')} as mask from s""")
def spliced_and_split(spark: SparkSession, d: str) -> DataFrame:
    """Pieces around a picture, each with its start token, and a history split into query, response and the model's part."""
    one, p, a = F.array(F.lit(1)), F.col("p"), F.col("a")
    span = lambda n, g: F.struct(n.alias("length"), F.lit(g).alias("generated"))
    spans = F.array(span(F.size(p), False), span(F.size(a), True), span(F.lit(2), False))
    split = sequences.dialogue_split(F.concat(p, a, F.array(F.lit(8), F.lit(9))), spans)
    rows = _halves(spark, d).select("doc_id", sequences.image_splice(F.array(F.concat(one, p), F.concat(one, a)), 1).alias("s"), split.alias("d"))
    return rows.select("doc_id", _digest(F.col("s")).alias("spliced"), *[_digest(F.col(f"d.{c}")).alias(c) for c in ("query", "response", "mask")])


# Order and repetition: a hash decides which row comes where; what must hold of any is compared


@query("with n as (select count(*) n from documents) select n::bigint as n, 0::bigint as first, (n-1)::bigint as last, n::bigint as places, least(n, 37)::bigint as drawn, (n//4)::bigint as head from n")
def shuffled_places(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id")
    drawn, head = sampling.sample_rows(docs, "doc_id", 37).count(), sampling.head_fraction(docs, 0.25, "doc_id").count()
    places = sampling.shuffle(docs, "doc_id").agg(F.count(F.lit(1)).alias("n"), F.min("place").alias("first"), F.max("place").alias("last"), F.count_distinct("place").alias("places"))
    return places.withColumns({"drawn": F.lit(drawn).cast("long"), "head": F.lit(head).cast("long")})


@query("with n as (select count(*) n from documents) select 'test' as split, ceil(n*0.1)::bigint as n from n union all select 'train', (n-ceil(n*0.1))::bigint from n")
def exact_split_sizes(spark: SparkSession, d: str) -> DataFrame:
    return sampling.exact_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.1).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("with n as (select count(*)//8*8 n from documents where doc_id is not null) select n::bigint as keys, (n*6)::bigint as positions, (n*6-1)::bigint as last, 6::bigint as times from n")
def repeat_plan_shape(spark: SparkSession, d: str) -> DataFrame:
    plan = sampling.repeat_plan(table(spark, d, "documents").where("doc_id is not null"), "doc_id", 8, 2, 3)
    per = plan.groupBy("doc_id").agg(F.count(F.lit(1)).alias("c"))
    times = per.agg(F.when(F.min("c") == F.max("c"), F.max("c")).alias("times")).scalar()
    return plan.agg(F.count_distinct("doc_id").alias("keys"), F.count_distinct("position").alias("positions"), F.max("position").alias("last")).withColumn("times", times)


@query("with n as (select count(*) n, sum(coalesce(length(text),0)) s from documents), k as (select n, s from n) select n::bigint as rows, n::bigint as ids, s::bigint as characters, ceil(n/64)::bigint as megabatches, 16::int as most from k")
def length_grouped_shape(spark: SparkSession, d: str) -> DataFrame:
    out = sampling.length_grouped(table(spark, d, "documents").withColumn("n", F.length("text")), "doc_id", "n", 16, 4)
    most = out.groupBy("megabatch", "chunk").agg(F.count(F.lit(1)).cast("int").alias("c")).agg(F.max("c").alias("most")).scalar()
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"), F.sum("length").alias("characters"), F.count_distinct("megabatch").alias("megabatches")).withColumn("most", most)


# Sources and sinks: written to the shared folder and read again


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/queries/{name}"


@query("select o_orderkey::varchar as o_orderkey, o_orderstatus from orders")
def csv_source(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "csv")
    table(spark, d, "orders").select("o_orderkey", "o_orderstatus").write.mode("overwrite").option("header", True).csv(path)
    return tabular.read_csv(spark, path)


@query("select event_type, round(avg(value),6) as mean_value, round(stddev_pop(value),6) as std_value from events group by 1")
def csv_summary(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "summary")
    tabular.write_csv_summary(_events(spark, d), "event_type", "value", path)
    return tabular.read_csv(spark, path).select("event_type", *[_r(F.col(c).cast("double")).alias(c) for c in ("mean_value", "std_value")])


@query("select distinct trim(sample_key, ' ') as sample_key from sample_index where trim(sample_key, ' ') <> ''")
def key_list(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "keys")
    tabular.write_ordered_lines(table(spark, d, "sample_index").where("sample_key is not null"), F.col("sample_key"), path, "sample_key", "tar_path")
    return tabular.read_keys(spark, path)


@query("select 'train' as split, event_id, event_type from events where event_id%10<>0 union all select 'test', event_id, event_type from events where event_id%10=0")
def json_splits(spark: SparkSession, d: str) -> DataFrame:
    files = {s: _place(spark, f"splits/{s}") for s in ("train", "test")}
    rows = _events(spark, d).select("event_id", "event_type")
    rows.where("event_id % 10 <> 0").write.mode("overwrite").json(files["train"])
    rows.where("event_id % 10 = 0").write.mode("overwrite").json(files["test"])
    read = tabular.read_splits(spark, files, "event_id long, event_type string")
    return read["train"].withColumn("split", F.lit("train")).unionByName(read["test"].withColumn("split", F.lit("test")))


@query("select o_orderkey, o_orderstatus from orders")
def cache_files(spark: SparkSession, d: str) -> DataFrame:
    """A cache of six files for three workers, without a column, read by its columns and by the beginning of file names."""
    path = _place(spark, "cache")
    tabular.write_cache(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_comment") if "o_comment" in table(spark, d, "orders").columns else table(spark, d, "orders"), path, 5, 3, drop=["o_comment"])
    return tabular.read_prefixed(spark, path, "part-").select("o_orderkey", "o_orderstatus").intersectAll(tabular.read_columns(spark, path, "o_orderkey", "o_orderstatus"))


@query("select 'loss '||(event_id//500) as line, (event_id//500)::double as value, count(*)::bigint as n from events group by 1,2")
def log_values(spark: SparkSession, d: str) -> DataFrame:
    path = _place(spark, "log")
    _events(spark, d).select(F.concat(F.lit("step "), F.col("event_id").cast("string"), F.lit(" loss: "), F.expr("event_id div 500").cast("string")).alias("value")).write.mode("overwrite").text(path)
    return tabular.read_log(spark, path, r"loss: (\d+)").groupBy("value").agg(F.count(F.lit(1)).alias("n")).withColumn("line", F.concat(F.lit("loss "), F.col("value").cast("int").cast("string")))


@query("select n_name as name, octet_length(encode(n_name))::bigint as bytes from nation")
def binary_files(spark: SparkSession, d: str) -> DataFrame:
    """One file for each nation, in a folder by its name."""
    path = _place(spark, "files")
    table(spark, d, "nation").select(F.col("n_name").alias("value"), F.col("n_name").alias("name")).repartition("name").write.mode("overwrite").partitionBy("name").option("lineSep", "\n").text(path)
    files = tabular.read_files(spark, path, "*.txt")
    name = F.url_decode(F.regexp_extract("path", r"name=([^/]+)/", 1))
    return files.select(name.alias("name"), (F.length("content") - 1).cast("long").alias("bytes"))


@query(f"""with {base._COPIES}, i as (select sample_key, min(tar_path) tar_path from sample_index where sample_key is not null group by 1), x as (select sample_key, "count", tar_path from k join i using(sample_key) where "count">0)
 select count(*)::bigint as members, sum("count")::bigint as copies, (select count(distinct coalesce(tar_path,'')) from x)::bigint as shards, 'meaninv' as reduction, 400.5::double as n_high from x""")
def membership_files(spark: SparkSession, d: str) -> DataFrame:
    """A membership with its shard list and configuration, written and read again."""
    folder = _place(spark, "membership")
    tabular.write_membership(membership_in_index(spark, d), folder, {"reduction": "meaninv", "n_high": 400.5})
    config = tabular.parse_config(spark.read.text(f"{folder}/config.json").first()[0])
    shards = spark.read.text(f"{folder}/shardlist").count()
    if not tabular.exists(spark, f"{folder}/membership.parquet"):
        raise RuntimeError("the membership is not complete")
    totals = spark.read.parquet(f"{folder}/membership.parquet").agg(F.count(F.lit(1)).alias("members"), F.sum("count").alias("copies"))
    return totals.withColumns({"shards": F.lit(shards).cast("long"), "reduction": F.lit(config["reduction"]), "n_high": F.lit(config["n_high"])})


@query("select * from (values ('a', 1, true), ('b', 2, false)) t(name, n, flag)")
def rows_source(spark: SparkSession, d: str) -> DataFrame:
    return tabular.rows(spark, {"name": ["a", "b"], "n": [1, 2], "flag": [True, False]}).withColumn("n", F.col("n").cast("int"))


@query("select event_id, event_type from events order by event_id desc limit 25")
def last_rows(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming import statistics

    return statistics.last_rows(_events(spark, d).select("event_id", "event_type"), 25, "event_id")


def _shards(spark: SparkSession, d: str) -> str:
    """Tar shards of all documents, sixteen at most, written by the tasks into the shared folder."""
    folder = _place(spark, "shards")
    rows = table(spark, d, "documents").where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 16).alias("shard"))

    def write(key: tuple, parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        files.create_dir(root, recursive=True)
        n = 0
        with files.open_output_stream(f"{root}/s{key[0]:02d}.tar") as out, tarfile.open(fileobj=out, mode="w|") as tar:
            for pdf in parts:
                for i, text in zip(pdf["doc_id"], pdf["text"]):
                    for ending, data in (("txt", text.encode()), ("json", json.dumps({"tagging_caption": text[:20]}).encode())):
                        info = tarfile.TarInfo(f"docs/{i}.{ending}")
                        info.size = len(data)
                        tar.addfile(info, io.BytesIO(data))
                        n += 1
        yield pd.DataFrame({"shard": [key[0]], "members": [n]})

    rows.groupBy("shard").applyInPandas(write, "shard long, members long").agg(F.sum("members")).first()
    return folder if "://" in folder else folder.removeprefix("file:")


@query("select count(*)::bigint as samples, count(distinct doc_id%16)::bigint as shards, sum(length(coalesce(text,'')))::bigint as characters, sum(length(coalesce(text,'')[1:20]))::bigint as captions, count(*)::bigint as keys from documents where doc_id is not null")
def tar_samples(spark: SparkSession, d: str) -> DataFrame:
    rows = webdataset.members(spark, _shards(spark, d), payload="true")
    keys = webdataset.sample_keys(rows, strip_folders=True).agg(F.count(F.lit(1)).alias("n")).scalar()
    captions = webdataset.sidecars(rows).agg(F.sum(F.length("caption")).alias("n")).scalar()
    samples = webdataset.samples(rows).agg(F.count(F.lit(1)).alias("samples"), F.count_distinct("__url__").alias("shards"), F.sum(F.length("txt")).alias("characters"))
    return samples.withColumns({"captions": captions, "keys": keys})


# Groups, draws and preparations


_HEADS = "h as (select node_id, coalesce(nullif(string_split(lower(trim(string_split(node_name,' (')[1])),' ')[-1],''),'(none)') grp from concepts)"


@query(f"""with {base._COUNTS}, {_HEADS}, x as (select coalesce(grp,'(none)') grp, n from c left join h using(node_id)), o as (select *, row_number() over (partition by grp order by n) i, row_number() over (partition by grp order by n desc) j, count(*) over (partition by grp) k from x)
 select grp, count(*)::bigint as nodes, sum(n)::bigint as links, round(sum(n)/(select sum(n) from c),8) as share, round(sum(case when j<=greatest(1, round_even(0.02*k,0)) then n else 0 end)/sum(n),8) as top_share, round(2.0*sum(i*n)/(max(k)*sum(n))-(max(k)+1.0)/max(k),8) as gini from o group by 1""")
def group_composition(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import audit

    head = F.coalesce(F.nullif(F.element_at(F.split(linking.base_name(F.col("node_name")), " "), -1), F.lit("")), F.lit("(none)"))
    groups = table(spark, d, "concepts").select("node_id", head.alias("grp"))
    out = audit.group_composition(rebalance.concept_counts(base._links(spark, d)), groups)
    return out.withColumns({c: _r(c, 8) for c in ("share", "top_share", "gini")})


@query(f"with {base._LINKS}, k as (select count(*) k from l group by sample_key), o as (select k, row_number() over (order by k)-1 i, count(*) over () n from k) select max(n)::bigint as samples, max(case when i=n//2 then k end)::bigint as median from o")
def nodes_per_sample(spark: SparkSession, d: str) -> DataFrame:
    from ..operators import audit

    return audit.nodes_per_sample(base._links(spark, d))


@query("select 500::bigint as draws, 500::bigint as places, true as known, true as again")
def draws_with_replacement(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id").where("doc_id is not null")
    drawn = sampling.sample_with_replacement(docs.limit(300), "doc_id", 500)  # fewer rows than draws: some come again
    lost = drawn.join(docs, "doc_id", "left_anti").count()
    return drawn.agg(F.count(F.lit(1)).alias("draws"), F.count_distinct("draw").alias("places"), F.lit(lost == 0).alias("known"), (F.count_distinct("doc_id") < 500).alias("again"))


@query("with n as (select count(*) filter (where doc_id%3<>0) a, count(*) filter (where doc_id%3=0) b from documents) select (a+b)::bigint as rows, (a+b)::bigint as ids, ceil((a+b)/64)::bigint as megabatches, (case when a%64>0 and b%64>0 then 1 else 0 end)::bigint as mixed from n")
def modality_grouped_shape(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, -F.coalesce(F.length("text"), F.lit(0)) - 1).otherwise(F.coalesce(F.length("text"), F.lit(0))).alias("n"))
    out = sampling.modality_grouped(docs, "doc_id", "n", 16, 4)
    kinds = out.groupBy("megabatch").agg(F.count_distinct(F.col("id") % 3 == 0).alias("k"))
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("id").alias("ids"), F.count_distinct("megabatch").alias("megabatches")).withColumn("mixed", kinds.agg(F.count_if(F.col("k") > 1).alias("m")).scalar())


@query("select user_id, event_id, value from events qualify row_number() over (partition by user_id order by value desc nulls last, event_id)<=3")
def best_of_three(spark: SparkSession, d: str) -> DataFrame:
    return advantages.best_of(_events(spark, d).select("user_id", "event_id", "value"), "user_id", "value", "event_id", 3)


@query(f"""with {_LASTS}, n as (select *, coalesce(list_min(list_filter(range(1, least(length(a),length(b))+1), lambda i: a[i]<>b[i]))-1, least(length(a),length(b))) k, least(length(a),length(b)) m from s),
 c as (select *, case when a is null or b is null then 0 else least(k, greatest(m-1,0)) end d from n), e as (select *, case when d>0 and a[d]=' ' then d-1 else d end f from c)
 select pref_id, substr(coalesce(a,''),1,f) as prompt, substr(a,f+1) as chosen, substr(b,f+1) as rejected from e""")
def text_prompts(spark: SparkSession, d: str) -> DataFrame:
    return conversation.maybe_extract_prompt(_lasts(spark, d).withColumnsRenamed({"a": "chosen", "b": "rejected"})).select("pref_id", "prompt", "chosen", "rejected")


@query("select event_id, (case when event_id%11=0 then -1 when value>=10 then 0 else 1 end)::int as winner, (case when value>=10 then 0 else 1 end)::int as first_rank, (case when value>=10 then 1 else 0 end)::int as second_rank from events")
def judged_pairs(spark: SparkSession, d: str) -> DataFrame:
    """A judge by value against ten, shown in either order, that fails on some; and ranks of the two."""
    rows = _events(spark, d).select("event_id", F.when(F.col("event_id") % 11 != 0, F.struct(F.col("value").alias("v"), F.lit(0).alias("p"))).alias("a"), F.struct(F.lit(10.0).alias("v"), F.lit(1).alias("p")).alias("b"), F.array("value", F.lit(10.0)).alias("both"))
    # ties go to the first of the pair, in whichever order it is shown
    won = judging.pairwise(rows, "event_id", "a", "b", lambda x, y: F.when((x["v"] > y["v"]) | ((x["v"] == y["v"]) & (x["p"] < y["p"])), 0).when(x.isNotNull() & y.isNotNull(), 1))
    ranked = judging.rank(won, "both", lambda v: v)
    return ranked.select("event_id", "winner", F.get("ranks", F.lit(0)).alias("first_rank"), F.get("ranks", F.lit(1)).alias("second_rank"))


def _lengths(text) -> F.Column:
    """A stand-in for a tokenizer: the lengths of words."""
    return F.transform(F.split(text, " "), lambda w: F.length(w))


_LEN = "list_transform(string_split({x}, ' '), lambda w: length(w)::int)"


@query(f"""with {_LASTS}, t as (select pref_id, {_LEN.format(x='prompt')} p, {_LEN.format(x='a')} a, {_LEN.format(x='b')} b from s join (select distinct pref_id, prompt from preferences where prompt is not null) using(pref_id) where a is not null and b is not null)
 select distinct pref_id, {_sql_digest('case when len(p)>6 then p[len(p)-5:] else p end')} as prompt, {_sql_digest('list_concat(a,[2])[1:9]')} as chosen, {_sql_digest('list_concat(b,[2])[1:9]')} as rejected from t""")
def preference_preparation(spark: SparkSession, d: str) -> DataFrame:
    from . import preparation

    pairs = _lasts(spark, d).withColumnsRenamed({"a": "chosen", "b": "rejected"}).join(table(spark, d, "preferences").select("pref_id", "prompt").where("prompt is not null").distinct(), "pref_id")
    out = preparation.preference(pairs.where("chosen is not null and rejected is not null"), _lengths, 2, 6, 9)
    return out.select("pref_id", _digest(F.col("prompt_input_ids")).alias("prompt"), _digest(F.col("chosen_input_ids")).alias("chosen"), _digest(F.col("rejected_input_ids")).alias("rejected")).distinct()


@query(f"with {_CONV}, r as (select conv_id, {_IM.format(l='l')} x from t) select conv_id, {_sql_digest(_LEN.format(x='case when ends_with(x, chr(10)||chr(10)) then x else x||chr(10)||chr(10) end') + '[1:50]')} as digest from r")
def supervised_preparation(spark: SparkSession, d: str) -> DataFrame:
    from . import preparation

    out = preparation.supervised(_conversations(spark, d), _lengths, 50, "conv_id", eos="\n\n")
    return out.select("conv_id", _digest(F.col("input_ids")).alias("digest"))


@query("select count(*) filter (where value>=10)::bigint as good, count(*) filter (where value is null or value<10)::bigint as bad from events")
def quarantined(spark: SparkSession, d: str) -> DataFrame:
    good, bad = tabular.quarantine(_events(spark, d), F.col("value") >= 10)
    side = lambda df, g: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(g).alias("g"), "n")
    return side(good, True).unionByName(side(bad, False)).agg(F.sum(F.when(F.col("g"), F.col("n"))).alias("good"), F.sum(F.when(~F.col("g"), F.col("n"))).alias("bad"))
