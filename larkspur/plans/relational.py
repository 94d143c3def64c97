"""Relational queries of the choice-log scenario, one text for two SQL dialects.

The log is lineitem joined with its order, customer, part and supplier: a search (text, location, filters, category) and the
item chosen. Its columns are made so that shares and strata differ: some texts are a searcher's own, some searchers stand on one side of
the split only, some filters name another type, some items have two titles. All queries read the whole log. A query is a function of a dialect, so both engines get the same logic with their own spelling of the few
functions that differ.
"""

from __future__ import annotations


class Spark:
    @staticmethod
    def hex6(e: str) -> str:
        return f"cast(conv(right(md5(cast({e} as string)), 6), 16, 10) as bigint)"

    @staticmethod
    def pct(e: str, q: float) -> str:
        return f"percentile({e}, {q})"

    @staticmethod
    def sorted_set(e: str) -> str:
        return f"array_sort(collect_set({e}))"

    @staticmethod
    def joined(e: str, order: str) -> str:
        return f"array_join(transform(array_sort(collect_list(struct({order}, {e} as v))), x -> cast(x.v as string)), ' ')"

    @staticmethod
    def size(e: str) -> str:
        return f"cast(size({e}) as bigint)"

    @staticmethod
    def common(a: str, b: str) -> str:
        return f"cast(size(array_intersect({a}, {b})) as bigint)"

    @staticmethod
    def unnest(e: str, name: str) -> str:
        return f"lateral view explode({e}) t as {name}"

    rlike = "rlike"


class DuckDB:
    @staticmethod
    def hex6(e: str) -> str:
        return f"cast('0x' || right(md5(cast({e} as varchar)), 6) as bigint)"

    @staticmethod
    def pct(e: str, q: float) -> str:
        return f"quantile_cont({e}, {q})"

    @staticmethod
    def sorted_set(e: str) -> str:
        return f"list_sort(list(distinct {e}))"

    @staticmethod
    def joined(e: str, order: str) -> str:
        return f"string_agg(cast({e} as varchar), ' ' order by {order}, {e})"

    @staticmethod
    def size(e: str) -> str:
        return f"cast(len({e}) as bigint)"

    @staticmethod
    def common(a: str, b: str) -> str:
        return f"cast(len(list_intersect({a}, {b})) as bigint)"

    @staticmethod
    def unnest(e: str, name: str) -> str:
        return f", unnest({e}) as t({name})"

    rlike = "similar to"


BASE = """
items as (select distinct l_partkey * 100000 + l_suppkey as item_id, p_name || case when l_partkey % 50 = 0 and l_linenumber % 2 = 0 then ' plus' else '' end as title, p_type as mc, p_brand as category, s_nationkey * 40 + cast(s_suppkey % 40 as int) as iloc,
    p_retailprice as price, 1 + cast(s_suppkey % 5 as int) as rating, cast(s_acctbal as double) as lat
  from lineitem join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey),
log as (select l_orderkey * 10 + l_linenumber as row_id, split_part(p_name, ' ', 2) || ' ' || lower(c_mktsegment) || case when o_orderkey % 4 = 0 then ' ' || cast(o_custkey as string) else '' end as query, c_nationkey * 40 + cast(o_custkey % 40 as int) as sloc, o_custkey as cust,
    case when l_partkey % 2 = 0 then 'Type ' || case when l_linenumber % 4 = 0 then 'PROMO' else p_type end else '' end as filters, case when l_orderkey % 10 = 0 then 0 else 114 end as category, l_orderkey % 3 = 0 as delivery,
    l_partkey * 100000 + l_suppkey as item_id, p_type as mc, s_nationkey * 40 + cast(s_suppkey % 40 as int) as iloc, l_quantity as qty
  from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join part on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey)"""


def _describe(d, e: str, prefix: str = "") -> str:
    parts = [f"cast(count({e}) as bigint) as {prefix}n", f"round(avg({e}), 4) as {prefix}mean", f"round(stddev_samp({e}), 4) as {prefix}std", f"cast(min({e}) as double) as {prefix}low", f"cast(max({e}) as double) as {prefix}high"]
    return ", ".join(parts + [f"round({d.pct(e, q)}, 4) as {prefix}p{int(100 * q)}" for q in (0.25, 0.5, 0.75, 0.9)])


SPLIT = """, marked as (select *, {b} % 1000 as bucket from log), t_log as (select * from marked where bucket >= 100), b_log as (select * from marked where bucket < 100)"""


def _split(d) -> str:
    return SPLIT.format(b=d.hex6("case when cust % 10 = 0 then cust else row_id end"))  # a tenth of the searchers are new to one side


def share(p: str) -> str:
    return f"round(avg(case when {p} then 1e0 else 0e0 end), 6)"


QUERIES = {
    # exploratory queries
    "e1_log_sizes": lambda d: "select count(distinct query) as n_queries, count(distinct item_id) as n_items, count(distinct query || '|' || sloc) as n_query_loc, count(distinct query || '|' || sloc || '|' || filters || '|' || category || '|' || delivery) as n_keys from log",
    "e1_rows_per_key": lambda d: f"select {_describe(d, 'n')} from (select count(*) as n from log group by query, sloc, filters, category, delivery) k",
    "e2_key_repeats": lambda d: _split(d) + " select count(*) as n_rows, count(distinct query) as n_texts, count(*) - count(distinct query || '|' || sloc || '|' || filters || '|' || category || '|' || delivery) as n_repeated from b_log",
    "e3_overlap_shares": lambda d: _split(d) + f""" select
      {share("query in (select query from t_log)")} as text_share,
      {share("exists (select 1 from t_log t where t.query = b.query and t.sloc = b.sloc)")} as query_loc_share,
      {share("exists (select 1 from t_log t where t.query = b.query and t.sloc = b.sloc and t.filters = b.filters and t.category = b.category and t.delivery = b.delivery)")} as key_share,
      {share("item_id in (select item_id from t_log)")} as item_share, {share("sloc in (select sloc from t_log)")} as loc_share from b_log b""",
    "e4_same_location": lambda d: f"select {share('sloc = iloc')} as same_loc, {share('category = 114')} as in_services from log",
    "e5_top_categories": lambda d: "select category, mc, count(*) as n from log group by category, mc order by n desc, category, mc limit 20",
    "e5_top_filters": lambda d: "select filters, count(*) as n from log where filters <> '' group by filters order by n desc, filters limit 15",
    "e6_delivery_and_filters": lambda d: f"select {share('delivery')} as delivery_share, {share(chr(102) + 'ilters = ' + chr(39) * 2)} as no_filter_share from log",
    "e7_distinct_locations": lambda d: "select count(distinct sloc) as n_sloc, count(distinct iloc) as n_iloc, count(distinct mc) as n_mc from log",
    "e8_items_per_location": lambda d: f", pool as (select iloc, count(*) as n from items group by iloc) select {_describe(d, 'coalesce(n, 0)')} from (select distinct query, sloc from log) q left join pool on q.sloc = pool.iloc",
    "e8_location_counts": lambda d: "select iloc, count(*) as n from items group by iloc",
    "e9_corpus_in_queried_locations": lambda d: _split(d) + f" select {share('iloc in (select sloc from b_log)')} as share from items",
    "e10_mismatch_pairs": lambda d: "select sloc, iloc, count(*) as n from log where sloc <> iloc group by sloc, iloc order by n desc, sloc, iloc limit 20",
    "e11_query_frequency": lambda d: f"select {_describe(d, 'n')} from (select query, count(*) as n from log group by query) q",
    "e11_top_queries": lambda d: "select query, count(*) as n from log group by query order by n desc, query limit 20",
    "e12_any_category": lambda d: "select row_id, query, sloc, filters, item_id from log where category = 0 and filters = ''",
    "e13_filter_shares": lambda d: f"select filters, count(*) as n, {share('mc = substr(filters, 6)')} as agree, round(avg(cast(length(filters) as double)), 4) as mean_length from log where filters <> '' group by filters",
    "e14_filter_crosstab": lambda d: "select mc, cast(count(*) filter (where category = 114) as bigint) as services, cast(count(*) filter (where category = 0) as bigint) as any_category, cast(count(*) filter (where delivery) as bigint) as delivery from log group by mc",
    "e14_mode_share": lambda d: "select query, round(max(n) / cast(sum(n) as double), 6) as mode_share from (select query, mc, count(*) as n from log group by query, mc) c group by query",
    "e15_location_coverage": lambda d: _split(d) + f", p as (select sloc, iloc, count(*) / cast(sum(count(*)) over (partition by sloc) as double) as p from t_log group by sloc, iloc) select {share('exists (select 1 from p where p.sloc = b.sloc and p.iloc = b.iloc and p.p >= 5e-3)')} as covered, count(*) as n from b_log b",
    "e16_location_ratio": lambda d: _split(d) + ", a as (select iloc as loc, count(*) as n from items group by iloc), b as (select iloc as loc, count(*) as n from t_log group by iloc) select coalesce(a.loc, b.loc) as loc, coalesce(a.n, 0) as corpus, coalesce(b.n, 0) as logged, round(coalesce(a.n, 0) / cast(greatest(coalesce(b.n, 0), 1) as double), 6) as ratio from a full join b on a.loc = b.loc",
    "e17_no_filter_by_frequency": lambda d: f", f as (select query, count(*) as n from log group by query) select case when n <= 3 then 'a' when n <= 100 then 'b' else 'c' end as bucket, count(*) as n_rows, {share('filters = ' + chr(39) * 2)} as no_filter from log join f using (query) group by case when n <= 3 then 'a' when n <= 100 then 'b' else 'c' end",
    "e18_one_key_per_text": lambda d: f"select query, sloc, filters, item_id from (select *, row_number() over (partition by query order by md5(cast(row_id as string)), row_id, item_id, sloc) as r from log) x where r = 1",
    "e18_text_frequency": lambda d: _split(d) + f", f as (select query, count(*) as n from t_log group by query) select {_describe(d, 'coalesce(n, 0)')} from (select distinct query from b_log) b left join f using (query)",
    "e19_items_per_key": lambda d: "select n_items, count(*) as n_keys from (select count(distinct item_id) as n_items from log group by query, sloc, filters, category, delivery) k group by n_items",
    "e20_pruning_ceiling": lambda d: _split(d) + f""", p as (select sloc, iloc, count(*) / cast(sum(count(*)) over (partition by sloc) as double) as p from t_log group by sloc, iloc),
      pool as (select iloc, count(*) as n from items group by iloc), th as (select 1e-3 as t union all select 5e-3 union all select 1e-2 union all select 2e-2 union all select 4e-2 union all select 5e-2 union all select 1e-1),
      q as (select distinct sloc from b_log), sizes as (select t, q.sloc, sum(case when p >= t then n else 0 end) as pool from th cross join q left join p on p.sloc = q.sloc left join pool on pool.iloc = p.iloc group by t, q.sloc),
      hit as (select t, avg(case when p.p >= t then 1e0 else 0e0 end) as recall from th cross join b_log b left join p on p.sloc = b.sloc and p.iloc = b.iloc group by t)
      select hit.t as threshold, round(recall, 6) as recall, round(median(cast(pool as double)), 4) as median_pool, cast(max(pool) as bigint) as max_pool from hit join sizes on hit.t = sizes.t group by hit.t, recall""",
    "e21_items_with_two_titles": lambda d: "select count(*) as n from (select item_id from items group by item_id having count(distinct title) > 1) x",
    # filters, joins, set operations
    "f3_groups_with_positive": lambda d: "select row_id, query, qty from (select *, max(case when qty >= 50 then 1 else 0 end) over (partition by query, sloc) as any_y from log) x where any_y > 0",
    "f6_category_rule": lambda d: "select category, count(*) as n from log where not (category = 114 and mc = 'PROMO') group by category",
    "j2_lookup_with_default": lambda d: ", g as (select iloc, count(*) / cast((select count(*) from log) as double) as share from log where iloc % 5 <> 0 group by iloc) select i.iloc, count(*) as n, round(max(coalesce(g.share, 1e-6)), 6) as base from items i left join g on i.iloc = g.iloc group by i.iloc",
    "j4_semi_on_key": lambda d: _split(d) + " select count(*) as n from b_log b where exists (select 1 from t_log t where t.query = b.query and t.sloc = b.sloc and t.filters = b.filters and t.category is not distinct from b.category and t.delivery is not distinct from b.delivery)",
    "j5_anti": lambda d: _split(d) + " select item_id, title, iloc from items i where not exists (select 1 from t_log t where t.item_id = i.item_id)",
    "j6_merge_with_fallback": lambda d: ", a as (select query, mc, count(*) as n from log group by query, mc), b as (select query, mc, max(qty) as m from log where delivery group by query, mc) select a.query, a.mc, coalesce(b.m, a.n - 1e6) as score from a left join b on a.query = b.query and a.mc = b.mc",
    "j12_same_group_other_item": lambda d: "select item_id, case when least_title <> title then least_item when next_title is not null then next_item end as other from (select i.*, h.least_item, h.least_title, h.next_item, h.next_title from items i join (select mc, iloc, category, max(case when r = 1 then title end) as least_title, max(case when r = 1 then first_item end) as least_item, max(case when r = 2 then title end) as next_title, max(case when r = 2 then first_item end) as next_item from (select mc, iloc, category, title, min(item_id) as first_item, row_number() over (partition by mc, iloc, category order by min(item_id)) as r from items group by mc, iloc, category, title) g group by mc, iloc, category) h on i.mc = h.mc and i.iloc = h.iloc and i.category = h.category) x where least_title <> title or next_title is not null",
    "u1_union_all": lambda d: _split(d) + " select 'b' as part, query, item_id from b_log union all select 't', query, item_id from t_log",
    "u3_difference": lambda d: _split(d) + " select distinct item_id from b_log except select item_id from t_log",
    "u4_overlap_sizes": lambda d: f", s as (select sloc, {d.sorted_set('mc')} as mcs, {d.sorted_set('iloc')} as locs from log group by sloc) select a.sloc, b.sloc as other, {d.common('a.locs', 'b.locs')} as n from s a join s b on a.sloc + 1 = b.sloc",
    "u5_explode": lambda d: f", r as (select query, sloc, {d.sorted_set('item_id')} as rel from log group by query, sloc) select query, sloc, item from r {d.unnest('rel', 'item')}",
    # aggregates
    "a3_value_shares": lambda d: "select mc, round(count(*) / cast(sum(count(*)) over () as double), 6) as share from log group by mc",
    "a5_median_by_group": lambda d: "select sloc, round(median(lat), 4) as lat, round(median(price), 4) as price from log join items using (item_id) group by sloc",
    "a7_describe": lambda d: f"select mc, {_describe(d, 'price')} from items group by mc",
    "a8_percentiles": lambda d: f"select round({d.pct('qty', 0.5)}, 4) as p50, round({d.pct('qty', 0.9)}, 4) as p90, max(qty) as top from log",
    "a10_sorted_relevant_lists": lambda d: f"select query, sloc, {d.sorted_set('item_id')} as rel from log group by query, sloc",
    "a14_row_distribution": lambda d: "select query, mc, round(n / cast(sum(n) over (partition by query) as double), 6) as p from (select query, mc, count(*) as n from log group by query, mc) c",
    "a15_smoothed_rates": lambda d: ", f as (select query, mc, case when sloc <> iloc then 1e0 else 0e0 end as far from log), g as (select avg(far) as g from f) select query, round((sum(far) + 2 * max(g)) / (count(*) + 2), 6) as query_rate from f cross join g group by query",
    "a16_weighted_average": lambda d: "select sloc, round(sum(price * qty) / sum(qty), 4) as mean_price from log join items using (item_id) group by sloc",
    "a19_mean_and_size": lambda d: f"select iloc, count(*) as n, {share('sloc = iloc')} as same_loc from log group by iloc",
    "a20_binned_histogram": lambda d: ", f as (select query, sloc, count(*) as n from log group by query, sloc) select case when n <= 2 then '(0,2]' when n <= 5 then '(2,5]' when n <= 10 then '(5,10]' when n <= 20 then '(10,20]' else '(20,]' end as bin, count(*) as n from f group by 1",
    "a21_two_level_mean": lambda d: "select delivery, filters <> '' as has_filter, round(avg(qty), 4) as mean_qty, count(*) as n from log group by delivery, filters <> ''",
    "a22_string_aggregate": lambda d: f"select query, sloc, {d.joined('item_id', 'row_id')} as answer from log group by query, sloc",
    "a24_zero_fill": lambda d: ", q as (select distinct query from log), h as (select query, count(*) as n from log where qty > 49 and category = 0 group by query) select q.query, coalesce(h.n, 0) as n from q left join h on q.query = h.query",
    # windows
    "w1_rank_min": lambda d: "select row_id, sloc, cast(rank() over (partition by query order by qty desc) as bigint) as rk from log",
    "w3_group_transforms": lambda d: "select row_id, max(qty) over (partition by query) as top, round(avg(qty) over (partition by query), 4) as mean, round(stddev_samp(qty) over (partition by query), 4) as std from log",
    "w4_limit_by_group": lambda d: ", k as (select query, 1 + count(distinct mc) % 3 as k from log group by query) select query, row_id, qty from (select l.*, k.k, row_number() over (partition by l.query order by qty desc, row_id) as r from log l join k on l.query = k.query) x where r <= k",
    "w5_group_head": lambda d: "select query, row_id, qty from (select *, row_number() over (partition by query order by qty desc, row_id) as r from log) x where r <= 15",
    "w6_gap_and_z": lambda d: "select row_id, qty - max(qty) over (partition by query) as gap, round((qty - avg(qty) over (partition by query)) / (stddev_samp(qty) over (partition by query) + 1e-6), 4) as z from log",
    "w7_gap_to_kth": lambda d: ", r as (select row_id, query, qty, row_number() over (partition by query order by qty desc, row_id) as r from log) select a.row_id, a.qty - b.qty as gap from r a join r b on a.query = b.query and b.r = 50 where a.r <= 60",
    "w8_max_normalised": lambda d: "select row_id, round(qty / (max(qty) over (partition by query) + 1e-6), 6) as v from log",
    "t4_first_of_key": lambda d: "select query, sloc, row_id from (select *, row_number() over (partition by query, sloc order by row_id) as r from log) x where r = 1",
    "t6_distinct_sorted": lambda d: "select distinct sloc, iloc from log order by sloc, iloc",
    "t7_global_head": lambda d: "select item_id, price from items order by price desc, item_id limit 25",
    # splits and samples
    "l1_hash_split": lambda d: f"select case when {d.hex6('item_id')} % 1000 < 640 then 'V' else 'T' end as part, count(*) as n from items group by 1",
    "l2_shared_items": lambda d: f", v as (select *, {d.hex6('item_id')} % 1000 as b, {d.hex6(chr(39) + 'shared|' + chr(39) + ' || item_id')} % 100 as s, {d.hex6(chr(39) + 'coin|' + chr(39) + ' || row_id')} % 2 as coin from log) select case when b >= 640 or (s < 45 and coin = 1) then 'T' else 'V' end as part, count(*) as n_rows, count(distinct item_id) as n_items from v group by 1",
    "l4_stratified_sample": lambda d: _split(d) + ", k as (select distinct query, sloc, case when query || '|' || sloc in (select query || '|' || sloc from t_log) then 1 else 0 end as seen from b_log) select query, sloc, seen from (select *, row_number() over (partition by seen order by md5(query || '|' || sloc), query, sloc) as r from k) x where (seen = 1 and r <= 37) or (seen = 0 and r <= 63)",
    "l5_capped_pairs": lambda d: "select query, item_id from (select query, item_id, row_number() over (partition by query order by md5(query || '|' || item_id), item_id) as r from (select distinct query, item_id from log) p) x where r <= 20",
    "l12_row_sample": lambda d: f"select row_id, query, item_id from log where {d.hex6('row_id')} % 100 < 3",
}


_SIDES = "count(case when bucket < 100 then 1 end) as b, count(case when bucket >= 100 then 1 end) as t"
_HIT = "round(sum(case when g = {g} and t > 0 and {known} then b else 0 end) / cast(nullif(sum(case when g = {g} then b else 0 end), 0) as double), 6) as {name}"
# Spark's own texts of queries whose plan from the common text computes the log once for each subquery: sides are counted by key in one pass.
PLANS = {
    "e3_overlap_shares": lambda d: _split(d) + f""", k as (select grouping_id() as g, query, sloc, filters, category, delivery, item_id, {_SIDES} from marked
      group by query, sloc, filters, category, delivery, item_id grouping sets ((query), (query, sloc), (query, sloc, filters, category, delivery), (item_id), (sloc)))
      select {_HIT.format(g=31, known="query is not null", name="text_share")}, {_HIT.format(g=15, known="query is not null and sloc is not null", name="query_loc_share")},
      {_HIT.format(g=1, known="query is not null and sloc is not null and filters is not null and category is not null and delivery is not null", name="key_share")},
      {_HIT.format(g=62, known="item_id is not null", name="item_share")}, {_HIT.format(g=47, known="sloc is not null", name="loc_share")} from k""",
}


def sql(name: str, dialect) -> str:
    body = (PLANS if dialect is Spark and name in PLANS else QUERIES)[name](dialect).strip()
    return f"with {BASE}{body if body.startswith(',') else ' ' + body}"
