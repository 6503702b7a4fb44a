"""One query per operator over the test tables, each with the SQL it must equal (null where SQL can't say it)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..context import table
from ..functions import numeric, sequences, text as X

from ..functions.schedule import Schedule
from ..operators import advantages, audit, catalog, conversation, judging, linking, losses, packing, rebalance, sampling, stratified, vectors
from ..plans.filter_language import where
from ..streaming import statistics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The schedule of the test queries: all three bands occur at any size of the test tables.
S = Schedule(n_high=400, n_low=40, a_head=1.0, r_min=0.1, gamma=0.5, m_max=4.0)
_P = "(cast(('0x'||right(sha256({k}),16)) as ubigint) & 9223372036854775807::ubigint)::bigint"
_H = "(" + _P + "::double/9223372036854775808.0)"
_LINKS = "l as (select distinct sample_key, node_id from concept_links where sample_key is not null and node_id is not null)"
_COUNTS = _LINKS + ", c as (select node_id, count(*) n from l group by 1)"
_M = "case when n>=400 then greatest(0.1, case when n>1 then 2.0/log10(n) else 1 end) when n<40 then least(4.0, pow(40.0/n,0.5)) else 1.0 end"
_NODES = _COUNTS + f", m as (select node_id, n, {_M} m_c from c)"
_MAX = _NODES + ", s as (select sample_key, max(m_c) m from l join m using(node_id) group by 1 union all select distinct sample_key, 1.0 from sample_index where sample_key is not null and sample_key not in (select sample_key from l))"
_COPIES = _MAX + f", k as (select sample_key, (floor(m) + case when {_H.format(k='sample_key')} < round(m-floor(m),12) then 1 else 0 end)::int as \"count\" from s)"
_MSG = "g as (select message_id, any_value(conv_id) conv_id, any_value(turn_idx) turn_idx, any_value(\"role\") \"role\", any_value(content) content, any_value(author_id) author_id, any_value(\"source\") \"source\" from messages where message_id is not null group by 1)"


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return add


def _links(spark: SparkSession, d: str) -> DataFrame:
    return linking.distinct_links(table(spark, d, "concept_links"))


def _nodes(links: DataFrame) -> DataFrame:
    return rebalance.node_multiplicity(rebalance.concept_counts(links), S)


def _messages(spark: SparkSession, d: str) -> DataFrame:
    """Each message once; deliveries of one message have the same content."""
    m = table(spark, d, "messages").where("message_id is not null")
    columns = ["conv_id", "turn_idx", "role", "content", "author_id", "source"]
    return m.groupBy("message_id").agg(*[F.any_value(c, True).alias(c) for c in columns])


def _r(column, digits: int = 6):
    return F.round(column, digits)


# Catalogue


@query(f"select sample_key, {_P.format(k='sample_key')} as priority, round({_H.format(k='sample_key')}, 9) as draw, min(tar_path) as tar_path from sample_index where sample_key is not null group by 1")
def index_priority(spark: SparkSession, d: str) -> DataFrame:
    return catalog.index(table(spark, d, "sample_index"), "sample_key", "tar_path").withColumn("draw", _r(F.col("draw"), 9))


@query("select sample_key, tar_path from sample_index where sample_key is not null qualify row_number() over (partition by sample_key order by indexed_at nulls last, tar_path nulls last)=1")
def index_first_wins(spark: SparkSession, d: str) -> DataFrame:
    return catalog.first_wins(table(spark, d, "sample_index").select("sample_key", "tar_path", "indexed_at"), "sample_key", "indexed_at", "tar_path").drop("indexed_at")


_SCORED = "x as (select sample_key, aesthetic_score a from sample_index where sample_key is not null qualify row_number() over (partition by sample_key order by indexed_at desc, tar_path desc, priority desc, aesthetic_score desc nulls last)=1)"


@query(f"with {_SCORED}, i as (select sample_key, min(tar_path) tar_path from sample_index where sample_key is not null group by 1) select i.sample_key, tar_path, a as aesthetic_score from i left join x using(sample_key)")
def enrich_scores(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "sample_index")
    index = catalog.index(samples, "sample_key", "tar_path").select("sample_key", "tar_path")
    order = samples.withColumn("score_order", F.struct(F.col("aesthetic_score").isNotNull(), F.col("aesthetic_score")))
    return catalog.enrich(index, order, ["aesthetic_score"], "indexed_at", "tar_path", "priority", "score_order")


@query("with k as (select distinct sample_key from sample_index where is_clean and sample_key is not null) select i.sample_key, k.sample_key is not null as clean from (select distinct sample_key from sample_index where sample_key is not null) i left join k using(sample_key)")
def enrich_flag(spark: SparkSession, d: str) -> DataFrame:
    samples = table(spark, d, "sample_index")
    keys = samples.select("sample_key").where("sample_key is not null").distinct()
    return catalog.flag(keys, samples.where("is_clean"), "clean")


_FILTER = "aesthetic_score > 5.0 and is_clean == True and primary_node != c9595723"


@query("select sample_key, tar_path, priority from sample_index where aesthetic_score is not null and not isnan(aesthetic_score) and aesthetic_score>5.0 and is_clean and primary_node is not null and primary_node<>'c9595723'")
def filter_language(spark: SparkSession, d: str) -> DataFrame:
    return where(table(spark, d, "sample_index"), _FILTER).select("sample_key", "tar_path", "priority")


@query("select sample_key, tar_path, priority from sample_index where not isnan(aesthetic_score) and aesthetic_score>5.0 order by priority, sample_key, tar_path limit 200")
def select_topk(spark: SparkSession, d: str) -> DataFrame:
    chosen = where(table(spark, d, "sample_index"), "aesthetic_score > 5.0")
    return chosen.orderBy("priority", "sample_key", "tar_path").limit(200).select("sample_key", "tar_path", "priority")


@query("with i as (select sample_key, min(tar_path) tar_path, min(priority) priority, bool_or(is_clean) is_clean from sample_index where sample_key is not null group by 1) select sample_key, tar_path from (select * from i order by priority, sample_key limit 500) where is_clean")
def scan_topk(spark: SparkSession, d: str) -> DataFrame:
    index = table(spark, d, "sample_index").where("sample_key is not null").groupBy("sample_key").agg(F.min("tar_path").alias("tar_path"), F.min("priority").alias("priority"), F.bool_or("is_clean").alias("is_clean"))
    return catalog.materialise(index, "is_clean == true", 500, "scan").select("sample_key", "tar_path")


@query(f"with {_COPIES} select substr(sha256(coalesce(string_agg(sample_key||chr(9)||\"count\"::varchar||chr(10), '' order by sample_key), '')),1,16) as membership_hash from k where \"count\">0")
def membership_hash(spark: SparkSession, d: str) -> DataFrame:
    line = F.concat("sample_key", F.lit("\t"), F.col("count").cast("string"))
    return spark.createDataFrame([(catalog.membership_hash(_copies(spark, d), line, "sample_key"),)], "membership_hash string")


@query(f"with {_COPIES} select distinct tar_path from sample_index join k using(sample_key) where \"count\">1 and tar_path is not null")
def shard_list(spark: SparkSession, d: str) -> DataFrame:
    kept = _copies(spark, d).where("count > 1").select("sample_key")
    return catalog.shards(table(spark, d, "sample_index").join(kept, "sample_key", "left_semi"))


@query("select (count(distinct sample_key)//256)::bigint as steps from sample_index")
def step_budget(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "sample_index").agg(F.expr("count(distinct sample_key) div 256").alias("steps"))


# Tags and links


def _tagged(spark: SparkSession, d: str) -> DataFrame:
    captions = F.get_json_object("content", "$.tagging_caption")
    return _messages(spark, d).select("message_id", linking.parse_tags(captions).alias("tags")).where("tags is not null")


_TAGS = _MSG + """, j as (select message_id, lower(json_extract_string(content,'$.tagging_caption')) t from g where json_valid(content) and content like '{%'),
 tg as (select distinct message_id, trim(regexp_replace(regexp_replace(unnest(string_split(t,',')),'\\s+',' ','g'),'^\\s*\\d+\\s+','')) tag from j where t is not null),
 tags as (select * from tg where tag<>'' and not regexp_matches(tag,'^[\\d\\s.]+$'))"""


@query(f'with {_TAGS} select tag, count(*)::bigint as "rows" from tags group by 1')
def tag_vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return linking.vocabulary(_tagged(spark, d))


_MATCH = _TAGS + """, n as (select lower(trim(string_split(node_name,' (')[1])) nm, node_id from concepts where node_id is not null and node_name is not null),
 f as (select * from n qualify row_number() over (partition by nm order by node_id)<=3),
 lk as (select distinct tag, nm, sc from (select tag, tag nm, 1.0 sc from tags union all select tag, string_split(tag,' ')[-1], 0.8 from tags)),
 h as (select tag, node_id, max(sc)::double score from lk join f using(nm) group by 1,2),
 mt as (select tag, node_id, score from (select *, max(score) over (partition by tag) best from h) where score>=best-0.03 qualify row_number() over (partition by tag order by score desc, node_id)<=3)"""


@query(f"with {_MATCH} select tag, node_id, score from mt")
def tag_matches(spark: SparkSession, d: str) -> DataFrame:
    return linking.match_tags(linking.vocabulary(_tagged(spark, d)), table(spark, d, "concepts")).select("tag", "node_id", "score")


@query(f"with {_MATCH} select distinct message_id, node_id from tags join mt using(tag)")
def tag_links(spark: SparkSession, d: str) -> DataFrame:
    tagged = _tagged(spark, d)
    return linking.links(tagged, linking.match_tags(linking.vocabulary(tagged), table(spark, d, "concepts")), "message_id")


@query(f"with {_LINKS} select count(*)::bigint as links, count(distinct sample_key)::bigint as samples, count(distinct node_id)::bigint as nodes from l")
def link_totals(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    return links.agg(F.count(F.lit(1)).alias("links"), F.count_distinct("sample_key").alias("samples"), F.count_distinct("node_id").alias("nodes"))


@query("select i.sample_key from (select distinct sample_key from sample_index where sample_key is not null) i where sample_key not in (select sample_key from concept_links where sample_key is not null and node_id is not null)")
def unlinked_samples(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "sample_index").select("sample_key").where("sample_key is not null").distinct()
    return keys.join(_links(spark, d), "sample_key", "left_anti")


# Rebalancing


@query(f'with {_COUNTS} select node_id, n as "N_c" from c')
def concept_counts(spark: SparkSession, d: str) -> DataFrame:
    return rebalance.concept_counts(_links(spark, d))


@query(f'with {_NODES} select node_id, n as "N_c", round(m_c,6) as m_c from m')
def node_multiplicity(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(_links(spark, d)).withColumn("m_c", _r("m_c"))


def _rarest(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    return rebalance.rarest_wins(links, _nodes(links), table(spark, d, "sample_index"))


def _copies(spark: SparkSession, d: str) -> DataFrame:
    return rebalance.membership(_rarest(spark, d))


@query(f"with {_MAX} select sample_key, round(m,6) as m from s")
def multiplicity_max(spark: SparkSession, d: str) -> DataFrame:
    return _rarest(spark, d).withColumn("m", _r("m"))


@query(f"""with {_NODES}, t as (select sample_key, sum(abs(ln(m_c))*ln(m_c)) a, sum(abs(ln(m_c))) b from l join m using(node_id) group by 1)
 select sample_key, round(least(4.0, case when b=0 then 1.0 else exp(a/b) end),6) as m from t""")
def multiplicity_geomean(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    return rebalance.geometric_mean(links, _nodes(links), m_max=4.0).withColumn("m", _r("m"))


_INVERSE = _COUNTS + """, w0 as (select sample_key, avg(pow(greatest(n,1),-0.5)) w from l join c using(node_id) group by 1),
 w as (select * from w0 union all select distinct sample_key, (select median(w) from w0 where w>0) from sample_index where sample_key is not null and sample_key not in (select sample_key from l))"""


@query(f"with {_INVERSE} select sample_key, round(w,8) as w from w")
def weight_meaninv(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    return rebalance.mean_inverse(links, rebalance.concept_counts(links), table(spark, d, "sample_index")).withColumn("w", _r("w", 8))


@query(f"""with recursive {_INVERSE}, o as (select w, row_number() over (order by w desc)-1 k, sum(w) over (order by w desc rows between unbounded preceding and current row)-w above, sum(w) over () tot, count(*) over () n from w),
 cut as (select * from o where (n-k*2.0)/(tot-above)*w<=2.0 order by k limit 1)
 select sample_key, round(least(2.0, w.w*(cut.n-cut.k*2.0)/(cut.tot-cut.above)),6) as m from w, cut""")
def multiplicity_budgeted(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    weights = rebalance.mean_inverse(links, rebalance.concept_counts(links), table(spark, d, "sample_index"))
    return rebalance.to_budget(weights, cap=2.0).withColumn("m", _r("m"))


@query(f'with {_COPIES} select sample_key, "count" from k where "count">0')
def membership_counts(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d)


@query(f'with {_COPIES} select sample_key, unnest(range("count"))::int as "copy" from k where "count">0')
def expanded_epoch(spark: SparkSession, d: str) -> DataFrame:
    return rebalance.expand(_copies(spark, d)).select("sample_key", "copy")


@query(f"""with {_COPIES} select count(*) filter (where "count">0)::bigint as distinct_samples, sum("count")::bigint as instances, max("count")::int as most from k""")
def realisation_totals(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).agg(F.count(F.lit(1)).alias("distinct_samples"), F.sum("count").alias("instances"), F.max("count").alias("most"))


_NAMED = _COUNTS + ", d as (select c.node_id, n, node_name, lower(trim(string_split(node_name,' (')[1])) base from c join concepts using(node_id))"


def _named_counts(spark: SparkSession, d: str) -> DataFrame:
    return rebalance.concept_counts(_links(spark, d)).join(table(spark, d, "concepts"), "node_id")


@query(f'with {_NAMED}, b as (select base from d where node_name is not null group by 1 having count(*)>1 and max(n)>=100) select node_id, n as "N_c", node_name, base from d join b using(base) where n<100')
def split_forms(spark: SparkSession, d: str) -> DataFrame:
    return rebalance.split_forms(_named_counts(spark, d), 100)


@query(f"""with {_NAMED}, b as (select base from d where node_name is not null group by 1 having count(*)>1 and max(n)>=100), s as (select * from d join b using(base) where n<100)
 select count(*)::bigint as nodes, sum(n)::bigint as links, count(*) filter (where n<100)::bigint as tail_nodes, count(*) filter (where n<100 and lower(node_name) in ('seal','bank'))::bigint as suspect_nodes,
 (select count(*) from s)::bigint as split_nodes, (select coalesce(sum(n),0) from s)::bigint as split_links, round((select coalesce(sum(n),0) from s)/sum(n),8) as split_share from d""")
def guard_audit(spark: SparkSession, d: str) -> DataFrame:
    return rebalance.guard_audit(_named_counts(spark, d), 100, ("seal", "bank")).withColumn("split_share", _r("split_share", 8))


# Audit


@query(f"with {_COUNTS}, o as (select n, row_number() over (order by n) i, count(*) over () k from c) select round(2.0*sum(i*n)/(max(k)*sum(n))-(max(k)+1.0)/max(k),8) as gini from o")
def gini(spark: SparkSession, d: str) -> DataFrame:
    return audit.gini(rebalance.concept_counts(_links(spark, d)), "N_c").select(_r("gini", 8).alias("gini"))


@query(f"with {_COUNTS}, o as (select n, row_number() over (order by n desc) i, count(*) over () k from c) select round(sum(case when i<=greatest(1, round_even(0.02*k,0)) then n else 0 end)/sum(n),8) as top_share from o")
def top_share(spark: SparkSession, d: str) -> DataFrame:
    return audit.top_share(rebalance.concept_counts(_links(spark, d)), "N_c").select(_r("top_share", 8).alias("top_share"))


_REALISED = _COPIES + ', z as (select node_id, sum(coalesce("count",0))::bigint mass from l left join k using(sample_key) group by 1), y as (select m.node_id, m.n, m_c, mass, mass/m.n rate, mass/m.n/m_c ratio from m join z using(node_id))'


@query(f'with {_REALISED} select node_id, n as "N_c", mass, round(rate,6) as rate, round(ratio,6) as ratio from y')
def realized_vs_intended(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    out = audit.realised(links, _copies(spark, d), _nodes(links))
    return out.select("node_id", "N_c", "mass", _r("rate").alias("rate"), _r("ratio").alias("ratio"))


@query(f"with {_REALISED} select node_id, round(ratio,6) as ratio from y where m_c<1 order by ratio desc, node_id limit 25")
def worst_offenders(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d)
    return audit.offenders(audit.realised(links, _copies(spark, d), _nodes(links)))[0].select("node_id", _r("ratio").alias("ratio"))


@query(f"with {_NODES} select case when n>=400 then 'head' when n<40 then 'tail' else 'mid' end as band, count(*)::bigint as nodes, sum(n)::bigint as links from m group by 1")
def concept_bands(spark: SparkSession, d: str) -> DataFrame:
    return audit.bands(_nodes(_links(spark, d)), S)


@query(f"with {_MAX} select count(*) filter (where m<=0)::bigint as dropped, count(*) filter (where m>0 and m<1)::bigint as thinned, count(*) filter (where m=1)::bigint as kept, count(*) filter (where m>1)::bigint as repeated, round(sum(m),4) as expected from s")
def sample_bands(spark: SparkSession, d: str) -> DataFrame:
    return audit.sample_bands(_rarest(spark, d)).withColumn("expected", _r("expected", 4))


@query(f"""with {_LINKS}, b as (select node_id, string_split(lower(trim(string_split(node_name,' (')[1])),' ')[-1] bucket from concepts where node_name is not null)
 select bucket, count(distinct sample_key)::bigint as samples from b left join l using(node_id) group by 1""")
def bucket_samples(spark: SparkSession, d: str) -> DataFrame:
    head = F.element_at(F.split(linking.base_name(F.col("node_name")), " "), -1)
    return audit.bucket_samples(_links(spark, d), table(spark, d, "concepts").where("node_name is not null").select("node_id", head.alias("bucket")))


@query(f"""with {_LINKS}, h as (select node_id, coalesce(nullif(string_split(lower(trim(string_split(node_name,' (')[1])),' ')[-1],''),'(none)') head from concepts)
 select head, node_id, count(*)::bigint as links, (case when head is null then 3 when node_id is null then 1 else 0 end)::bigint as "level" from l join h using(node_id) group by rollup(head, node_id)""")
def composition(spark: SparkSession, d: str) -> DataFrame:
    return audit.composition(_links(spark, d), table(spark, d, "concepts"))


@query(f'with {_COUNTS} select node_id, n as "N_c", coalesce(node_name,node_id) as name from (select * from c order by n desc, node_id limit 20) left join concepts using(node_id)')
def top_concepts(spark: SparkSession, d: str) -> DataFrame:
    return audit.top_concepts(rebalance.concept_counts(_links(spark, d)), table(spark, d, "concepts"))


@query(f"""with {_COUNTS}, r as (select *, case when n<100 then 1.0 else greatest(0.05, least(1.0, 2.0*0.6/log10(n))) end rate from c)
 select node_id, n as "N_c", round(rate,8) as rate, greatest(1, least(n, round_even(rate*n,0)))::bigint as quota from r""")
def keep_quotas(spark: SparkSession, d: str) -> DataFrame:
    q = stratified.quotas(rebalance.concept_counts(_links(spark, d)), 100, 0.6, 0.05)
    return q.select("node_id", "N_c", _r("rate", 8).alias("rate"), "quota")


@query()
def stratified_select(spark: SparkSession, d: str) -> DataFrame:
    links = _links(spark, d).join(table(spark, d, "sample_index").select("sample_key").distinct(), "sample_key", "left_semi")
    return stratified.select(links, stratified.quotas(rebalance.concept_counts(links), 100, 0.6, 0.05))


# Conversations


_RENDER = "string_agg('<|im_start|>'||\"role\"||chr(10)||coalesce(content,'')||'<|im_end|>'||chr(10), '' order by turn_idx, message_id)"


@query(f"with {_MSG} select conv_id, {_RENDER} as text from g where conv_id is not null group by 1")
def chat_template(spark: SparkSession, d: str) -> DataFrame:
    return conversation.apply_template(conversation.conversations(_messages(spark, d)))


@query("""with p as (select pref_id, coalesce(chosen,[]) c, coalesce(rejected,[]) r from preferences),
 q as (select pref_id, c, r, least(len(c),len(r)) n from p), z as (select pref_id, c, r, n, coalesce(list_min(list_filter(range(n), lambda i: c[i+1] is distinct from r[i+1])), greatest(n-1,0)) k from q)
 select pref_id, k::int as prompt_turns, (len(c)-k)::int as chosen_turns, (len(r)-k)::int as rejected_turns from z""")
def extract_prompt(spark: SparkSession, d: str) -> DataFrame:
    empty = F.expr("cast(array() as array<struct<role:string,content:string>>)")
    pairs = table(spark, d, "preferences").select("pref_id", F.coalesce("chosen", empty).alias("chosen"), F.coalesce("rejected", empty).alias("rejected"))
    return conversation.extract_prompt(pairs).select("pref_id", F.size("prompt").alias("prompt_turns"), F.size("chosen").alias("chosen_turns"), F.size("rejected").alias("rejected_turns"))


@query("select pref_id, prompt, chosen[-1].content as completion, true as label from preferences union all select pref_id, prompt, rejected[-1].content, false from preferences")
def unpair_preference(spark: SparkSession, d: str) -> DataFrame:
    last = lambda c: F.try_element_at(c, F.lit(-1))["content"].alias(c)
    return conversation.unpair(table(spark, d, "preferences").select("pref_id", "prompt", last("chosen"), last("rejected")))


@query("select pref_id, prompt, chosen[-1].content as completion from preferences where coalesce(length(prompt),0)+coalesce(length(chosen[-1].content),0)<=200")
def length_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "preferences").select("pref_id", "prompt", F.try_element_at("chosen", F.lit(-1))["content"].alias("completion"))
    return conversation.within_length(rows, 200, "prompt", "completion")


@query(f"""with {_MSG}, j as (select message_id, content, case when content like '{{%' and json_valid(content) then json_extract_string(content,'$.short_caption') end c, case when content like '{{%' and json_valid(content) then json_exists(content,'$.short_caption') else false end e from g where content is not null)
 select message_id, case when e then coalesce(c,'') else content end as caption from j""")
def captions(spark: SparkSession, d: str) -> DataFrame:
    rows = _messages(spark, d).where("content is not null")
    return rows.select("message_id", X.caption(F.col("content"), "short_caption", F.col("content")).alias("caption"))


@query("select doc_id, 'Please generate image based on the following caption: '||text as prompt, '<image>' as answer from documents where text is not null")
def t2i_prompts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").withColumn("c", X.image_conversation(F.lit(None).cast("string"), F.col("text")))
    return rows.select("doc_id", F.get("c", F.lit(0))["content"].alias("prompt"), F.get("c", F.lit(1))["content"].alias("answer"))


@query(f"""with {_MSG} select message_id, case when starts_with(content,'<think>') and contains(content,'</think>') and len(string_split(content,'<think>'))=2 then 1.0 else 0.0 end as reward from g where content is not null""")
def think_format_reward(spark: SparkSession, d: str) -> DataFrame:
    return _messages(spark, d).where("content is not null").select("message_id", X.think_reward(F.col("content")).alias("reward"))


@query(f"with {_MSG} select message_id, case when ends_with(content,'<|im_end|>') then content else content||'<|im_end|>' end as text, (-abs(20-length(content)))::double as length_reward from g where content is not null")
def eos_and_length(spark: SparkSession, d: str) -> DataFrame:
    rows = _messages(spark, d).where("content is not null")
    return rows.select("message_id", X.with_eos(F.col("content")).alias("text"), X.length_reward(F.col("content")).alias("length_reward"))


@query(f"with {_MSG}, b as (select message_id, content, message_id//64 batch from g) select message_id, coalesce(lag(content) over w, last_value(content) over (partition by batch order by message_id rows between unbounded preceding and unbounded following)) as mismatched from b where content is not null window w as (partition by batch order by message_id)")
def kl_ring_shift(spark: SparkSession, d: str) -> DataFrame:
    rows = _messages(spark, d).where("content is not null").withColumn("batch", F.expr("message_id div 64"))
    return conversation.ring_shift(rows, "batch", "message_id", "content", "mismatched").select("message_id", "mismatched")


# Token sequences: a text's tokens are the lengths of its words


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("tokens"))


_TOK = "t as (select doc_id, list_transform(string_split(text,' '), lambda w: length(w)::int) tokens from documents where text is not null)"
_SUM = "list_sum(list_transform({x}, lambda v, i: v*((i-1)%97+1)))::bigint"


def _digest(column):
    """An order-dependent sum of an array."""
    return F.aggregate(F.transform(column, lambda v, i: v * (i % 97 + 1)), F.lit(0).cast("long"), lambda a, v: a + v)


@query(f"with {_TOK} select doc_id, len(tokens[1:64])::int as n, {_SUM.format(x='tokens[1:64]')} as digest from t")
def truncate_lists(spark: SparkSession, d: str) -> DataFrame:
    cut_off = sequences.truncate(F.col("tokens"), 64)
    return _tokens(spark, d).select("doc_id", F.size(cut_off).alias("n"), _digest(cut_off).alias("digest"))


@query(f"""with {_TOK}, e as (select doc_id//50 pack_group, doc_id, unnest(tokens) v, generate_subscripts(tokens,1) i from t), o as (select *, row_number() over (partition by pack_group order by doc_id, i)-1 p from e)
 select pack_group, (p//128)::bigint as piece, count(*)::int as n, sum(v*((p%128)%97+1))::bigint as digest from o group by 1,2""")
def pack_wrapped(spark: SparkSession, d: str) -> DataFrame:
    rows = _tokens(spark, d).select(F.expr("doc_id div 50").alias("pack_group"), F.col("doc_id").alias("id"), "tokens")
    return packing.pack_wrapped(rows, 128).select("pack_group", "piece", F.size("tokens").alias("n"), _digest("tokens").alias("digest"))


@query()
def pack_best_fit(spark: SparkSession, d: str) -> DataFrame:
    rows = _tokens(spark, d).select(F.expr("doc_id div 500").alias("pack_group"), F.col("doc_id").alias("id"), "tokens")
    return packing.pack_best_fit(rows, 512)


@query(f"with {_TOK}, b as (select doc_id, tokens t, doc_id//16 batch from t), w as (select batch, ((max(len(t))+7)//8)*8 n from b group by 1) select doc_id, n::int as width, (n-len(t))::int as padding, {_SUM.format(x='t')} as digest from b join w using(batch)")
def pad_batches(spark: SparkSession, d: str) -> DataFrame:
    rows = _tokens(spark, d).select("doc_id", F.col("tokens").alias("t"), F.expr("doc_id div 16").alias("batch"))
    out = packing.pad_batches(rows, "batch", "t", multiple=8)
    return out.select("doc_id", F.size("t").alias("width"), F.size(F.filter("t_mask", lambda m: m == 0)).alias("padding"), _digest("t").alias("digest"))


@query(f"with {_TOK}, s as (select doc_id, tokens[1:len(tokens)//3] p, tokens[len(tokens)//3+1:] c from t) select doc_id, (len(p)+len(c))::int as n, len(c)::int as ones, {_SUM.format(x='list_concat(list_transform(p, lambda v: -100), c)')} as label_digest from s")
def completion_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = _tokens(spark, d).select("doc_id", F.expr("slice(tokens, 1, int(size(tokens) div 3))").alias("p"), F.expr("slice(tokens, int(size(tokens) div 3) + 1, size(tokens))").alias("c"))
    mask = sequences.completion_mask(F.col("p"), F.col("c"))
    return rows.select("doc_id", F.size(mask).alias("n"), F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("ones"), _digest(sequences.labels(F.concat("p", "c"), mask)).alias("label_digest"))


@query(f"with {_TOK} select doc_id, coalesce(nullif(list_position(tokens,13),0)-1, len(tokens))::int as stop_at, coalesce(nullif(list_position(tokens,13),0), len(tokens))::int as kept from t")
def stop_truncation(spark: SparkSession, d: str) -> DataFrame:
    flags = F.transform("tokens", lambda t: t == 13)
    return _tokens(spark, d).select("doc_id", sequences.first_true(flags).alias("stop_at"), F.size(sequences.after_stop(F.col("tokens"), 13)).alias("kept"))


@query(f"with {_TOK}, s as (select doc_id//8 g, list(len(tokens) order by doc_id) ls from t group by 1) select g, list_sum(ls)::int as n, list_sum(list_transform(ls, lambda x: x*(x-1)//2))::bigint as digest from s")
def packed_positions(spark: SparkSession, d: str) -> DataFrame:
    rows = _tokens(spark, d).groupBy(F.expr("doc_id div 8").alias("g")).agg(F.transform(F.sort_array(F.collect_list(F.struct("doc_id", F.size("tokens").alias("n")))), lambda s: s["n"]).alias("ls"))
    p = sequences.position_ids(F.col("ls"))
    return rows.select("g", F.size(p).alias("n"), F.aggregate(p, F.lit(0).cast("long"), lambda a, x: a + x).alias("digest"))


# Rewards and advantages: user_id is the prompt, value the reward


def _events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


@query("select event_id, round((value-avg(value) over w)/(coalesce(stddev_samp(value) over w,0)+1e-4),6) as advantage from events where user_id is not null window w as (partition by user_id)")
def grpo_advantage(spark: SparkSession, d: str) -> DataFrame:
    return advantages.group_relative(_events(spark, d), "user_id", "value").select("event_id", _r("advantage").alias("advantage"))


@query("select event_id, round(value-(sum(value) over w-value)/nullif(count(value) over w-1,0),6) as advantage from events where user_id is not null window w as (partition by user_id)")
def rloo_advantage(spark: SparkSession, d: str) -> DataFrame:
    return advantages.leave_one_out(_events(spark, d), "user_id", "value").select("event_id", _r("advantage").alias("advantage"))


@query("with s as (select user_id, event_type, stddev_samp(round(value)) s from events group by 1,2) select avg((abs(s)<=1e-8)::int)::double as frac_zero_std from s where s is not null")
def flat_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select(F.struct("user_id", "event_type").alias("g"), F.round("value").alias("v"))
    return advantages.flat_groups(rows, "g", "v")


@query("""with recursive o as (select user_id, event_id//500 episode, value, row_number() over w t, count(*) over (partition by user_id, event_id//500) n from events window w as (partition by user_id, event_id//500 order by event_id)),
 x as (select user_id, episode, t, n, value r, value/7 v, coalesce(lead(value/7) over (partition by user_id, episode order by t),0) vn from o),
 g as (select user_id, episode, t, r+0.99*vn-v adv from x where t=n union all select x.user_id, x.episode, x.t, x.r+0.99*x.vn-x.v+0.99*0.95*g.adv from x join g on x.user_id=g.user_id and x.episode=g.episode and x.t=g.t-1)
 select user_id, episode, t::int as t, round(adv,6) as advantage from g""")
def gae(spark: SparkSession, d: str) -> DataFrame:
    steps = _events(spark, d).groupBy("user_id", F.expr("event_id div 500").alias("episode")).agg(F.sort_array(F.collect_list(F.struct("event_id", "value"))).alias("s"))
    r, v = F.transform("s", lambda x: x["value"]), F.transform("s", lambda x: x["value"] / 7)
    out = steps.select("user_id", "episode", F.posexplode(sequences.gae(r, v, 0.99, 0.95)).alias("t", "advantage"))
    return out.select("user_id", "episode", (F.col("t") + 1).alias("t"), _r("advantage").alias("advantage"))


@query("""with s as (select event_id//500 step, count(value) c, sum(value) s, sum(value*value) q from events group by 1)
 select step, (sum(c) over w)::bigint as n, round(sum(s) over w/sum(c) over w,6) as mean, round(sum(q) over w/sum(c) over w-pow(sum(s) over w/sum(c) over w,2),4) as var from s window w as (order by step)""")
def running_moments(spark: SparkSession, d: str) -> DataFrame:
    out = statistics.running_moments(_events(spark, d).withColumn("step", F.expr("event_id div 500")), "step", "value")
    return out.select("step", "n", _r("mean").alias("mean"), _r("var", 4).alias("var"))


@query("""with e as (select event_id, user_id, event_id//1000 step, value from events), b as (select step, avg(value) bm, stddev_pop(value) bs from e group by 1),
 h as (select a.user_id, a.step, x.value, row_number() over (partition by a.user_id, a.step order by x.step desc, x.event_id desc) k from (select distinct user_id, step from e) a join e x on a.user_id=x.user_id and x.step<=a.step),
 p as (select user_id, step, count(*) n, avg(value) m, stddev_pop(value) s from h where k<=32 group by 1,2)
 select event_id, round((value-case when n>=16 then m else bm end)/(case when n>=16 then s else bs end+1e-6),5) as advantage from e join p using(user_id,step) join b using(step)""")
def prompt_tracker(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select("event_id", "user_id", F.expr("event_id div 1000").alias("step"), "value")
    return statistics.tracked_advantages(rows, "user_id", "step", "value", "event_id", 32, 16).select("event_id", _r("advantage", 5).alias("advantage"))


@query("select event_id, case when count(*) over w=100 then round(avg(value) over w,6) end as rolling from events window w as (order by event_id rows between 99 preceding and current row)")
def rolling_mean(spark: SparkSession, d: str) -> DataFrame:
    return advantages.rolling_mean(_events(spark, d).select("event_id", "value"), "event_id", "value", 100).select("event_id", _r("rolling").alias("rolling"))


@query("""select 'value' as reward, count(value)::bigint as n, round(avg(value),6) as mean, round(stddev_samp(value),6) as std, min(value) as least, max(value) as most, median(value) as median from events
 union all select 'half', count(v), round(avg(v),6), round(stddev_samp(v),6), min(v), max(v), median(v) from (select case when event_type<>'error' then value/2 end v from events)""")
def reward_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("half", F.when(F.col("event_type") != "error", F.col("value") / 2))
    return advantages.reward_statistics(rows, "value", "half").withColumns({"mean": _r("mean"), "std": _r("std")})


@query("""select round(avg(n),6) as mean_length, min(n)::int as min_length, max(n)::int as max_length, round(1-count(*) filter (where d)/count(*),8) as clipped_ratio, round(coalesce(avg(n) filter (where d),0),6) as mean_terminated, coalesce(min(n) filter (where d),0)::int as min_terminated, coalesce(max(n) filter (where d),0)::int as max_terminated
 from (select length(text) n, ends_with(text,'.') d from documents where text is not null)""")
def length_statistics(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").select(F.length("text").alias("n"), F.endswith("text", F.lit(".")).alias("d"))
    out = advantages.length_statistics(rows, "n", "d")
    return out.withColumns({"mean_length": _r("mean_length"), "clipped_ratio": _r("clipped_ratio", 8), "mean_terminated": _r("mean_terminated")})


@query("with m as (select avg(value) filter (where event_type<>'error') m, var_samp(value) filter (where event_type<>'error') v from events) select event_id, round((value-m)/sqrt(v+1e-8),6) as white from events, m")
def masked_whiten(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("mask", (F.col("event_type") != "error").cast("int"))
    return advantages.whitened(rows, "value", "mask").select("event_id", _r("white").alias("white"))


@query("""with c as (select greatest(count(*) filter (where event_type in ('click','purchase')),1) d, count(*) n from events), u as (select d, greatest(n-d,1) u from c)
 select d::bigint as desirable, u::bigint as undesirable, round_even(u/d,2) as desirable_low, round_even(u/d*1.33,2) as desirable_high, round_even(d/u/1.33,2) as undesirable_low, round_even(d/u,2) as undesirable_high from u""")
def label_balance(spark: SparkSession, d: str) -> DataFrame:
    return advantages.label_balance(_events(spark, d).withColumn("label", F.col("event_type").isin("click", "purchase")), "label")


@query("with p as (select user_id, max(value) filter (where event_type='click') a, max(value) filter (where event_type='view') b from events group by 1) select round(avg(case when a<>b then (a>b)::int end),8) as accuracy, (count(*) filter (where a=b))::bigint as ties from p")
def pairwise_accuracy(spark: SparkSession, d: str) -> DataFrame:
    side = lambda t: F.max(F.when(F.col("event_type") == t, F.col("value")))
    rows = _events(spark, d).groupBy("user_id").agg(side("click").alias("a"), side("view").alias("b"))
    return advantages.pairwise_accuracy(rows, "a", "b").withColumn("accuracy", _r("accuracy", 8))


@query("with w as (select case when value>80 then -1 when value>20 then 1 else 0 end w, 1/(1+exp(-(value-20)/10)) p from events) select count(*)::bigint as n, round(avg((w=1)::int),8) as win_rate, round(1-avg(p),8) as win_probability from w")
def win_rate(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select(F.when(F.col("value") > 80, -1).when(F.col("value") > 20, 1).otherwise(0).alias("w"), numeric.softmax_pair(F.col("value"), F.lit(20.0), 10.0).alias("p"))
    return judging.win_rate(rows, "w", "p").withColumns({"win_rate": _r("win_rate", 8), "win_probability": _r("win_probability", 8)})


@query("select user_id, event_id, value from events qualify row_number() over (partition by user_id order by value desc nulls last, event_id)=1")
def best_of_n(spark: SparkSession, d: str) -> DataFrame:
    return advantages.best_of(_events(spark, d).select("user_id", "event_id", "value"), "user_id", "value", "event_id")


@query("""with g as (select event_id//100 step, event_id, value/50 z from events), k as (select * from g qualify rank() over (partition by step order by z desc)<=20),
 p as (select step, event_id, exp(z-max(z) over (partition by step)) e from k), q as (select *, e/sum(e) over (partition by step) pr from p),
 r as (select *, coalesce(sum(pr) over (partition by step order by pr desc, event_id rows between unbounded preceding and 1 preceding),0) b from q) select step, event_id, round(pr,8) as probability from r where b<=0.9""")
def nucleus_filter(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select(F.expr("event_id div 100").alias("step"), "event_id", (F.col("value") / 50).alias("z"))
    return advantages.nucleus(rows, "step", "event_id", "z", 20, 0.9).select("step", "event_id", _r("probability", 8).alias("probability"))


@query("with q as (select quantile_cont(value,0.8) q from events where event_type<>'error') select event_id, (event_type<>'error' and value>=q) as high from events, q")
def high_entropy_mask(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).withColumn("m", (F.col("event_type") != "error").cast("int"))
    return advantages.high_entropy(rows, "value", "m", 0.8).select("event_id", "high")


@query("select event_type as prompt, user_id, event_id from events qualify row_number() over (partition by event_type order by event_id)=1")
def completions_table(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d).select(F.col("event_type").alias("prompt"), "user_id", "event_id")
    return advantages.first_per_prompt(rows, "prompt", "event_id")


@query("select event_type, avg(value) is not null as any, round(avg(value),6) as mean_value, round(stddev_pop(value),6) as std_value, round(median(value),6) as median_value from events group by 1")
def model_summary(spark: SparkSession, d: str) -> DataFrame:
    out = advantages.model_summary(_events(spark, d), "event_type", "value")
    return out.select("event_type", "any", *[_r(c).alias(f"{c}_value") for c in ("mean", "std", "median")])


@query("with h as (select * from documents where text is not null order by doc_id limit 400) select round(sum(length(text))/sum(len(string_split(text,' '))),8) as ratio from h")
def characters_per_token(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").where("text is not null").withColumn("n", F.size(F.split("text", " ")))
    return advantages.characters_per_token(rows, "text", "n", "doc_id").withColumn("ratio", _r("ratio", 8))


_PAIR = "p as (select event_id, -value/10 c, -value/7 r, -value/9 fc, -value/8 fr from events), q as (select *, (c-r)-(fc-fr) m, c-fc g, r-fr b from p)"
_LS = "(-(greatest(-({x}),0)+ln(1+exp(-abs({x})))))"
_SG = "(1/(1+exp(-({x}))))"


def _ls(x: str) -> str:
    return _LS.format(x=x)


def _sg(x: str) -> str:
    return _SG.format(x=x)


@query(
    f"""with {_PAIR} select event_id, round(-0.9*{_ls('.1*m')}-0.1*{_ls('-.1*m')},6) as sigmoid, round((-0.9*{_ls('.1*m')}+0.1*{_ls('-.1*m')})/0.8,6) as robust, round(greatest(0,1-.1*m),6) as hinge, round(pow(m-5,2),6) as ipo,
 round({_sg('.1*m')}*({_ls('.1*m')}-ln(0.9))+{_sg('-.1*m')}*({_ls('-.1*m')}-ln(0.1)),6) as exo_pair, round(pow(g-5,2)+pow(b+5,2),6) as sppo_hard, round(-{_ls('.1*g')}-0.5*{_ls('-.1*g')}-0.5*{_ls('-.1*b')},6) as nca_pair,
 round(1-{_sg('.1*g')}+{_sg('.1*b')},6) as apo_zero, round({_sg('.1*g')}+1-{_sg('.1*(g-b)')},6) as apo_down, round(-{_ls('.1*m')}*(1-{_sg('2*m')})+exp(-.1*m)*{_sg('2*m')},6) as discopop, round(.1*g,6) as chosen_reward from q"""
)
def dpo_losses(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    p = losses.Pair(-v / 10, -v / 7, -v / 9, -v / 8)
    kinds = ["sigmoid", "robust", "hinge", "ipo", "exo_pair", "sppo_hard", "nca_pair", "apo_zero", "apo_down", "discopop"]
    return _events(spark, d).select("event_id", *[_r(losses.dpo_loss(k, p, 0.1, 0.1)).alias(k) for k in kinds], _r(losses.implicit_reward(p.chosen, p.ref_chosen)).alias("chosen_reward"))


@query(f"with {_PAIR} select event_id, round(-{_ls('.1*((c-r)-5)')},6) as simpo, round(-{_ls('.1*(c-r)')},6) as sigmoid, round(greatest(0,1-.1*(c-r)),6) as hinge, round(pow((c-r)-5,2),6) as ipo from q")
def cpo_losses(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return _events(spark, d).select("event_id", *[_r(losses.reference_free_loss(k, -v / 10, -v / 7)).alias(k) for k in ("simpo", "sigmoid", "hinge", "ipo")])


@query(f"with z as (select greatest(avg(value)/100,0) z from events) select event_id, round(case when event_type in ('click','purchase') then 1-{_sg('.1*(value/20-z)')} else 1-{_sg('.1*(z-value/20)')} end,6) as loss from events, z")
def kto_losses(spark: SparkSession, d: str) -> DataFrame:
    rows = _events(spark, d)
    kl = rows.agg((F.avg("value") / 100).alias("z")).scalar()
    return rows.select("event_id", _r(losses.kto_loss(F.col("event_type").isin("click", "purchase"), F.col("value") / 20, kl)).alias("loss"))


@query("select event_id, round(-least(least(exp(value/100),2.0)*1.5, least(greatest(exp(value/100),0.8),1.2)*1.5),6) as loss, round(exp(-value/100)+value/100-1,6) as k3 from events")
def clipped_surrogate(spark: SparkSession, d: str) -> DataFrame:
    ratio = F.exp(F.col("value") / 100)
    return _events(spark, d).select("event_id", _r(losses.clipped_surrogate(ratio, F.lit(1.5), cap=2.0)).alias("loss"), _r(losses.kl_estimate(F.col("value") / 100, F.lit(0.0), "k3")).alias("k3"))


@query("""with a as (select value/10 x, row_number() over (order by value/10)-1 p from events where event_type='click'), b as (select value/12 y, row_number() over (order by value/12)-1 p from events where event_type='view')
 select a.p as place, round(x-y,8) as gap from a join b using(p)""")
def sorted_gap(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    rows = _events(spark, d).select(F.when(F.col("event_type") == "click", v / 10).alias("x"), F.when(F.col("event_type") == "view", v / 12).alias("y"))
    return advantages.sorted_gap(rows, "x", "y").withColumn("gap", _r("gap", 8))


# Vectors


_CENTROIDS = "e as (select vec_id, label, embedding::double[] v from embeddings where embedding is not null), u as (select vec_id, label, unnest(v) x, generate_subscripts(v,1) i from e), c as (select label, i, avg(x) m from u group by 1,2)"


@query(f"with {_CENTROIDS}, d as (select vec_id, c.label code, sum((x-m)*(x-m)) d from u join c using(i) group by 1,2) select vec_id, arg_min(code, d)::int as code, round(min(d),5) as distance from d group by 1")
def nearest_code(spark: SparkSession, d: str) -> DataFrame:
    import numpy as np

    vecs = table(spark, d, "embeddings")
    rows = vectors.centroids(vecs, "label", "embedding").orderBy("label").limit(10_001).collect()  # a codebook is a fixed set of codes
    if len(rows) > 10_000:
        raise ValueError("more labels than a codebook may have")
    book = np.array([r.centroid for r in rows])
    return vectors.nearest_code(vecs, "vec_id", "embedding", book).withColumn("distance", _r("distance", 5))


@query(f"with {_CENTROIDS} select label, i::int as i, round(m,6) as m from c")
def label_centroids(spark: SparkSession, d: str) -> DataFrame:
    return vectors.centroids(table(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("centroid").alias("p", "m")).select("label", (F.col("p") + 1).alias("i"), _r("m").alias("m"))


@query()
def density_ratio(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").withColumn("y", F.col("label") < 3)
    return vectors.density_ratio(rows, "y", "embedding").select("vec_id", "probability", "ratio")


# Order, splits, sets


@query()
def exact_split(spark: SparkSession, d: str) -> DataFrame:
    return sampling.exact_split(table(spark, d, "documents").select("doc_id"), "doc_id", 0.1)


@query("with n as (select count(*) n from orders) select o_orderkey, case when row_number() over (order by o_orderkey)-1>=n-100 then 'test' else 'train' end as split from orders, n")
def hold_out_last(spark: SparkSession, d: str) -> DataFrame:
    return sampling.hold_out_last(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 100)


@query("select o_orderkey, (row_number() over (order by o_totalprice desc, o_orderkey)-1)::bigint as place from orders")
def distributed_rank(spark: SparkSession, d: str) -> DataFrame:
    return sampling.ranked(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), F.col("o_orderkey")).select("o_orderkey", "place")


@query()
def repeat_plan(spark: SparkSession, d: str) -> DataFrame:
    return sampling.repeat_plan(table(spark, d, "documents").where("doc_id is not null"), "doc_id", 8, 2, 3)


@query()
def length_grouped(spark: SparkSession, d: str) -> DataFrame:
    return sampling.length_grouped(table(spark, d, "documents").withColumn("n", F.length("text")), "doc_id", "n", 16, 4)


@query("select o_orderkey, (o_orderkey%7)::bigint as shard from orders")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", sampling.round_robin(F.col("o_orderkey"), 7).alias("shard"))


@query("select c_custkey as k, 'c' as t from customer union all select s_suppkey, 's' from supplier")
def union_all(spark: SparkSession, d: str) -> DataFrame:
    one = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("c").alias("t"))
    return one.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("s").alias("t")))


@query("select distinct node_id from concept_links where node_id is not null intersect select node_id from concepts")
def known_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select("node_id").intersect(table(spark, d, "concepts").select("node_id"))


@query("select node_id from concepts except select node_id from concept_links")
def unused_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "concepts").select("node_id").exceptAll(_links(spark, d).select("node_id").distinct()).distinct()


@query("select l_orderkey, l_partkey, l_quantity from lineitem where l_quantity>45 and l_discount<0.02")
def pushed_filter(spark: SparkSession, d: str) -> DataFrame:
    return where(table(spark, d, "lineitem"), "l_quantity > 45 and l_discount < 0.02").select("l_orderkey", "l_partkey", "l_quantity")


@query("""with c as (select l_partkey, count(distinct l_orderkey) n from lineitem group by 1) select l_orderkey, round(max(case when n<40 then least(4.0, pow(40.0/n,0.5)) else 1.0 end),6) as m from (select distinct l_orderkey, l_partkey from lineitem) join c using(l_partkey) group by 1""")
def orders_rarest_part(spark: SparkSession, d: str) -> DataFrame:
    links = linking.distinct_links(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("sample_key"), F.col("l_partkey").alias("node_id")))
    nodes = rebalance.node_multiplicity(rebalance.concept_counts(links), Schedule(n_high=1e9, n_low=40, m_max=4.0))
    return rebalance.rarest_wins(links, nodes).select(F.col("sample_key").alias("l_orderkey"), _r("m").alias("m"))


@query("select r_name, n_name, count(*)::bigint as customers from customer join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey group by rollup(r_name, n_name)")
def taxonomy_rollup(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(F.broadcast(table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))  # TPC-H fixes both at 25 and 5 rows
    joined = table(spark, d, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"))
