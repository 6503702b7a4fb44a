"""SQL that queries of this subpackage must equal, where SQL can say it."""

_WORDS = """m as (select message_id, any_value(content) as content from messages where message_id is not null group by 1),
 w as (select message_id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+')) as term from m),
 t as (select term, count(*)::bigint as occurrences, count(distinct message_id)::bigint as messages, max(message_id) as last_message_id from w group by 1),
 k as (select *, case when messages < 3 then 'rare' when messages > 0.05 * (select count(*) from m) then 'common' end as mark from t)"""

_QUOTA = """m as (select distinct sample_key, nullif(lower(trim(primary_node)), '') as node from sample_index where sample_key is not null),
 s as (select node, count(*) as n from m where node is not null group by 1), t as (select count(distinct sample_key) as total from m),
 x as (select a.config_name, a.node_id, coalesce(n, 0) as n, target_share * sample_fraction * total as wanted, c.* exclude (config_name) from target_mix a join schedule_config c using (config_name)
  left join s on s.node = lower(trim(a.node_id)), t where target_share is not null and n_low > 0 and n_low <= n_high and r_min between 0 and 1 and m_max >= 1)"""

_BOUNDED = f"""{_QUOTA.replace("as n, target_share", "as n, target_share, target_share")}, names as (select lower(trim(node_id)) as node, min(node_name) as name from concepts where node_id is not null group by 1),
 y as (select config_name, node_id, n, target_share, wanted, case when n < n_low then n when n >= n_high then r_min * n else 0 end::double as least, (m_max * n)::double as most,
  coalesce(nullif(string_split_regex(trim(regexp_replace(lower(name), '\\s*\\(.*$', '')), '\\s+')[-1], ''), lower(trim(x.node_id))) as family from x left join names on names.node = lower(trim(x.node_id))),
 g0 as (select *, least(greatest(wanted, least), most) as given from y)"""


def _passed(level: str, before: str, after: str) -> str:
    """What is short or too much passed on within a level: rows of `before` with its lack, as rows of `after`."""
    sums = f"sum(lack) over w as net, sum(most - given) over w as up, sum(given - least) over w as down, count(*) over w as k from {before} window w as (partition by {level})"
    given = "given + case when net > 0 and up > 0 then least(net, up) * (most - given) / up when net < 0 and down > 0 then -least(-net, down) * (given - least) / down else 0 end as given"
    lack = "case when net > 0 then greatest(net - up, 0) else least(net + down, 0) end / k as lack"
    return f"{after} as (select * exclude (given, lack, net, up, down, k), {given}, {lack} from (select *, {sums}))"


_ALLOCATED = f"{_BOUNDED}, g1 as (select *, wanted - given as lack from g0), {_passed('config_name, family', 'g1', 'g2')}, {_passed('config_name', 'g2', 'g3')}"

# every pair that shares a triple of words, counted; groups of copies beyond 64 are stars in the query, which the tables lack
_TRIPLES = """m as (select message_id, any_value(content) as content from messages where message_id is not null and role in ('user', 'assistant') group by 1),
 w as (select message_id, regexp_extract_all(lower(content), '[\\p{L}\\p{N}]+') as ws from m where content is not null),
 s as (select message_id, list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) as ts from w where len(ws) >= 30),
 e as (select message_id, len(ts) as n, unnest(ts) as t from s),
 c as (select a.message_id as message_id_a, b.message_id as message_id_b, a.n as na, b.n as nb, count(*) as shared from e a join e b on a.t = b.t and a.message_id < b.message_id group by all),
 p as (select *, shared / (na + nb - shared) as similarity from c where 2 * shared >= na + nb - shared)"""
_CLASSES = f"""{_TRIPLES}, k as (select message_id, min(message_id) over (partition by list_sort(ts)) as class, count(*) over (partition by list_sort(ts)) as copies from s)"""

SQL = {
    "p1_found": f"with {_WORDS} select term, mark from k where mark is not null",
    "p1_term_frequency": f"with {_WORDS} select term, occurrences, messages, last_message_id, mark from k",
    "p2_found": f"with {_TRIPLES} select message_id_a, message_id_b from p",
    "p2_class_pairs": f"""with {_CLASSES} select message_id_a as class_a, message_id_b as class_b, x.copies as copies_a, y.copies as copies_b, similarity
 from p join k x on x.message_id = message_id_a join k y on y.message_id = message_id_b where x.class = message_id_a and y.class = message_id_b and x.class <> y.class""",
    "p3_allocation": f"""with {_ALLOCATED} select config_name, node_id, family, n, target_share, wanted, least, most, wanted <= most and wanted >= least as met, given,
 greatest(ceil(least - 1e-9), least(round(given), floor(most + 1e-9)))::bigint as quota, sum(lack) over (partition by config_name) as unplaced from g3""",
    "p3_found": f"with {_QUOTA} select config_name, node_id from x where wanted > m_max * n or wanted < case when n < n_low then n when n >= n_high then r_min * n else 0 end",
}
