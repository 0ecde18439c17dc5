"""The same results as plain SQL over the sample tables, one text per query."""

from __future__ import annotations

from cartlens import constants as C

BEHAVIOR = """
behavior as (
  select nullif(user_id, 0) as user_id,
         cast(json_extract_string(props, '$.k') as bigint) % 25 as product_id,
         case event_type when 'click' then 'add_to_cart'
                         when 'error' then 'remove_from_cart' else event_type end as action,
         value as duration_sec, ts as created_at
  from events),
logs as (
  select user_id, product_id, action, coalesce(duration_sec, 0.0) as duration_sec, created_at
  from behavior where user_id is not null and product_id is not null),
recent_logs as (select * from logs where created_at >= timestamp '2024-01-28 00:00:00')"""


def _scores(name: str, source: str) -> str:
    return f"""
{name} as (
  select user_id, product_id,
         greatest(sum(case action when 'view' then 1.0 when 'search' then 1.0
                                  when 'wishlist' then 2.0 when 'add_to_cart' then 3.0
                                  when 'remove_from_cart' then -1.0 when 'purchase' then 5.0
                                  else 0.0 end
                      + least(duration_sec / 30.0, 10.0) * 0.1), 0.0) as score,
         count(*) as n_events
  from {source} group by user_id, product_id)"""


SCORES = BEHAVIOR + "," + _scores("scores", "logs")

SHOP = """
shop_orders as (
  select o_orderkey as order_id, o_custkey as user_id,
         case o_orderstatus when 'F' then 'delivered' when 'O' then 'pending'
                            when 'P' then 'cancelled' end as order_status,
         cast(o_totalprice as double) as order_total, o_orderdate as created_at
  from orders),
delivered as (select * from shop_orders where order_status = 'delivered'),
order_items as (
  select l_orderkey as order_id, cast(l_linenumber as bigint) as line_no,
         l_partkey % 25 as product_id, cast(l_quantity as double) as quantity,
         l_partkey as tie_1, l_suppkey as tie_2
  from lineitem),
products as (
  select p_partkey % 25 as product_id, arg_min(p_name, p_partkey) as name, min(p_partkey) % 2 = 0 as is_consumable,
         case when min(p_partkey) % 10 <> 0 then arg_min(p_size, p_partkey) * 10.0 end::double as weight_gram
  from part group by p_partkey % 25),
users as (
  select c_custkey as user_id,
         case when c_mktsegment = 'MACHINERY' then 'staff' else 'customer' end as role,
         c_acctbal >= 0 as is_active,
         case when c_custkey % 50 <> 0
              then date '1995-01-01' + cast(c_custkey % 1000 as integer) end as created_at
  from customer)"""

LINES = SHOP + """,
lines as (
  select i.order_id, i.product_id from order_items i join delivered d on d.order_id = i.order_id),
items as (
  select order_id, product_id, count(*) as n_lines from lines group by order_id, product_id),
total as (select count(distinct order_id) as n from items)"""

RULES = LINES + """,
frequent as (
  select product_id, count(*) as n_baskets, count(*) / (select n from total) as support
  from items group by product_id having count(*) / (select n from total) >= 0.003),
pairs as (
  select a.product_id as item_a, b.product_id as item_b, count(*) as n_baskets,
         count(*) / (select n from total) as support
  from items a join items b on a.order_id = b.order_id and a.product_id < b.product_id
  group by a.product_id, b.product_id having count(*) / (select n from total) >= 0.003),
directed as (
  select item_a as a, item_b as b, n_baskets, support from pairs
  union all select item_b, item_a, n_baskets, support from pairs),
rules as (
  select d.a as antecedent_id, d.b as consequent_id, d.support,
         d.n_baskets / fa.n_baskets as confidence,
         (cast(d.n_baskets as double) * (select n from total))
           / (cast(fa.n_baskets as double) * fb.n_baskets) as lift
  from directed d join frequent fa on fa.product_id = d.a join frequent fb on fb.product_id = d.b
  where d.n_baskets / fa.n_baskets >= 0.1
    and (cast(d.n_baskets as double) * (select n from total))
           / (cast(fa.n_baskets as double) * fb.n_baskets) >= 1.0)"""

RULE_COLUMNS = """antecedent_id, consequent_id, round(support, 6) as support,
       round(confidence, 6) as confidence, round(lift, 6) as lift"""

ASSOCIATED = RULES + """,
ranked as (
  select *, row_number() over (partition by antecedent_id
                               order by lift desc, confidence desc, consequent_id) as rank
  from rules),
associated as (
  select antecedent_id as product_id, rank, consequent_id as recommended_id,
         round(confidence, 4) as confidence, round(lift, 4) as lift
  from ranked where rank <= 5)"""

TRENDING = """
trending as (
  select product_id, score, row_number() over (order by score desc, product_id) as rank
  from (select i.product_id, sum(i.quantity) as score
        from order_items i join delivered d on d.order_id = i.order_id group by i.product_id)
  qualify rank <= 10)"""

SIMILARITY = """
positive as (select user_id, product_id, score from scores where score > 0),
norms as (select product_id, sqrt(sum(score * score)) as norm from positive group by product_id),
similarity as (
  select a.product_id as item_a, b.product_id as item_b,
         sum(a.score * b.score) / (any_value(na.norm) * any_value(nb.norm)) as similarity
  from positive a join positive b on a.user_id = b.user_id and a.product_id < b.product_id
  join norms na on na.product_id = a.product_id join norms nb on nb.product_id = b.product_id
  group by a.product_id, b.product_id),
routing as (
  select user_id, count(*) filter (where score > 0) as n_interacted from scores group by user_id),
thin as (select user_id from routing where n_interacted < 24)"""


def _lists(requested: str) -> str:
    """Similarity lists, spelled out over all users and products."""
    return f"""
near as (
  select item_a as item, item_b as other, similarity from similarity
  union all select item_b, item_a, similarity from similarity),
candidates as (
  select r.user_id, p.product_id
  from {requested} r cross join (select distinct product_id from scores) p
  where not exists (select 1 from positive s
                    where s.user_id = r.user_id and s.product_id = p.product_id)),
scored as (
  select k.user_id, n.other as product_id,
         round(sum(n.similarity * k.score) / (sum(n.similarity) + 1e-9), 4) as score
  from positive k join near n on n.item = k.product_id
  where k.user_id in (select user_id from {requested})
  group by k.user_id, n.other),
lists as (
  select c.user_id, c.product_id, coalesce(s.score, 0.0) as score,
         row_number() over (partition by c.user_id
                            order by coalesce(s.score, 0.0) desc, c.product_id) as rank
  from candidates c left join scored s on s.user_id = c.user_id and s.product_id = c.product_id
  qualify rank <= 10)"""


THIN_LISTS = SCORES + "," + SIMILARITY + "," + _lists("thin")

HOMEPAGE = """
useful as (select user_id from lists group by user_id having max(abs(score)) > 0),
homepage as (
  select user_id, product_id, score, rank, 'collaborative' as rec_type
  from lists where user_id in (select user_id from useful)
  union all
  select r.user_id, t.product_id, t.score, t.rank, 'trending'
  from requested r cross join trending t
  where r.user_id not in (select user_id from useful))"""

FEATURES = SHOP + """,
summary as (
  select user_id, count(order_id) as total_orders, sum(order_total) as total_spent,
         max(created_at) as last_order_at
  from delivered group by user_id),
features as (
  select u.user_id, coalesce(s.total_orders, 0) as total_orders,
         coalesce(s.total_spent, 0.0) as total_spent,
         case when coalesce(s.total_orders, 0) > 0 then s.total_spent / s.total_orders
              else 0.0 end as avg_order_value,
         coalesce(date_diff('day', cast(s.last_order_at as date), date '2001-08-02'), 9999)
           as days_since_last_order,
         coalesce(date_diff('day', u.created_at, date '2001-08-02'), 1) as account_age_days
  from users u left join summary s on s.user_id = u.user_id
  where u.role = 'customer' and u.is_active),
user_features as (
  select *, total_orders / greatest(account_age_days / 30.0, 1.0)::double as purchase_frequency
  from features)"""

LABELS = FEATURES + f""",
profile as (
  select cast(user_id % 4 as integer) as cluster, avg(total_orders) as total_orders,
         avg(total_spent) as total_spent, avg(avg_order_value) as avg_order_value,
         avg(days_since_last_order) as days_since_last_order,
         avg(purchase_frequency) as purchase_frequency
  from user_features group by 1),
limits as (
  select quantile_cont(total_spent, 0.75) as spent,
         quantile_cont(days_since_last_order, 0.75) as recency,
         quantile_cont(purchase_frequency, 0.5) as frequency
  from profile),
coded as (
  select cluster, case when total_spent > spent then 'vip'
                       when days_since_last_order > recency then 'inactive'
                       when purchase_frequency > frequency then 'loyal'
                       else 'potential' end as code
  from profile, limits),
labels as (
  select cast(cluster + 1 as bigint) as segment_id, code,
         case code when 'vip' then '{C.SEGMENT_NAMES["vip"]}'
                   when 'inactive' then '{C.SEGMENT_NAMES["inactive"]}'
                   when 'loyal' then '{C.SEGMENT_NAMES["loyal"]}'
                   else '{C.SEGMENT_NAMES["potential"]}' end as name,
         'Cụm ' || cluster || ' - tự động phân loại bởi K-Means' as description
  from coded),
membership as (
  select user_id, cast(user_id % 4 + 1 as bigint) as segment_id from user_features)"""

HISTORY = SHOP + """,
history as (
  select d.user_id, i.product_id, d.created_at as order_date, i.order_id, i.line_no, i.tie_1,
         i.tie_2, i.quantity, p.weight_gram
  from order_items i join delivered d on d.order_id = i.order_id
  join products p on p.product_id = i.product_id and p.is_consumable),
lagged as (
  select *, cast(floor(date_diff('second', lag(order_date) over w, order_date) / 86400)
                 as bigint) as gap
  from history
  window w as (partition by user_id, product_id
               order by order_date, order_id, line_no, tie_1, tie_2, quantity)),
gaps as (
  select user_id, product_id, order_id, line_no, tie_1, tie_2, quantity, weight_gram,
         gap as days_between
  from lagged where gap between 1 and 365),
cycles as (
  select user_id, product_id, avg(gap) as avg_days_between
  from lagged where gap is not null group by user_id, product_id),
pair_state as (
  select user_id, product_id, weight_gram, max(order_date) as last_purchase,
         avg(quantity) as avg_quantity
  from history group by user_id, product_id, weight_gram),
encoder as (
  select product_id, row_number() over (order by product_id) - 1 as product_code
  from (select distinct product_id from gaps)),
training as (
  select g.user_id, g.product_id, g.order_id, g.line_no, g.tie_1, g.tie_2, g.quantity,
         coalesce(g.weight_gram, (select quantile_cont(weight_gram, 0.5) from gaps), 0.0)
           as weight_gram,
         e.product_code,
         avg(g.days_between) over (partition by g.user_id, g.product_id) as avg_days_between,
         g.days_between
  from gaps g join encoder e on e.product_id = g.product_id),
serving as (
  select s.user_id, s.product_id, s.last_purchase, coalesce(s.avg_quantity, 1.0) as quantity,
         coalesce(s.weight_gram, (select quantile_cont(weight_gram, 0.5) from pair_state), 0.0)
           as weight_gram,
         e.product_code, coalesce(c.avg_days_between, 30.0) as avg_days_between
  from pair_state s join encoder e on e.product_id = s.product_id
  left join cycles c on c.user_id = s.user_id and c.product_id = s.product_id)"""

PREDICTIONS = HISTORY + """,
cycled as (
  select *, cast(floor(greatest(avg_days_between, 1.0)) as integer) as cycle,
         cast(last_purchase as date) as last_day,
         cast(floor(date_diff('second', last_purchase, timestamp '2001-08-02') / 86400)
              as integer) as elapsed
  from serving),
predictions as (
  select user_id, product_id,
         case when last_day + cycle >= date '2001-08-02' then last_day + cycle
              else date '2001-08-02' + (cycle - elapsed % cycle) end as predicted_date,
         0.75 as confidence, false as notified
  from cycled),
due as (
  select p.*, n.name as product_name from predictions p
  join products n on n.product_id = p.product_id
  where p.predicted_date between date '2001-08-02' and date '2001-08-02' + 3)"""


def _with(parts: str, select: str) -> str:
    return f"with {parts.strip()}\n{select.strip()}"


TIME = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') as {0}"
LOG_COLUMNS = f"user_id, product_id, action, round(duration_sec, 6) as duration_sec, {TIME.format('created_at')}"
LINE_COLUMNS = "user_id, product_id, order_id, line_no, tie_1, tie_2, round(quantity, 6) as quantity"
PREDICTION_COLUMNS = """user_id, product_id, strftime(predicted_date, '%Y-%m-%d') as predicted_date,
       cast(confidence as double) as confidence"""

_PIVOT = ",\n       ".join(
    f"round(coalesce(max(score) filter (where product_id = {p}), 0.0), 6) as p{p}"
    for p in range(25)
)
_PROFILE = " union all ".join(
    f"select '{name}' as feature, cast(round(avg({name}), 2) as double) as mean, "
    f"cast(round(min({name}), 2) as double) as min, cast(round(max({name}), 2) as double) as max "
    "from user_features"
    for name in C.SEGMENT_FEATURES
)
_SCALED = ",\n       ".join(
    f"case when stddev_pop({n}) over () > 0 then round(({n} - avg({n}) over ()) "
    f"/ stddev_pop({n}) over (), 6) else 0.0 end as {n}"
    for n in C.SEGMENT_FEATURES
)

ORACLES = {
    "behavior_logs": _with(BEHAVIOR, f"select {LOG_COLUMNS} from logs"),
    "behavior_logs_since": _with(BEHAVIOR, f"select {LOG_COLUMNS} from recent_logs"),
    "interaction_scores": _with(
        SCORES, "select user_id, product_id, round(score, 6) as score, n_events from scores"
    ),
    "interaction_matrix": _with(SCORES, f"select user_id, {_PIVOT} from scores group by user_id"),
    "interaction_profile": _with(
        SCORES,
        """
select cast(sum(n_events) as bigint) as total_logs, count(distinct user_id) as unique_users,
       count(distinct product_id) as unique_products,
       round(100.0 * (count(distinct user_id) * count(distinct product_id)
                      - count(*) filter (where score > 0))
             / (count(distinct user_id) * count(distinct product_id)), 2)::double as sparsity_pct
from scores""",
    ),
    "action_distribution": _with(
        BEHAVIOR,
        "select action, count(*) as n_events from logs where action is not null group by action",
    ),
    "user_routing": _with(
        SCORES,
        """
select user_id, n_interacted,
       case when n_interacted >= (select count(distinct product_id) from scores) then 'best_sellers'
            when n_interacted >= 5 then 'factors' when n_interacted >= 1 then 'similarity'
            else 'best_sellers' end as route
from (select user_id, count(*) filter (where score > 0) as n_interacted
      from scores group by user_id)""",
    ),
    "heldout_rms": _with(
        SCORES
        + """,
folds as (
  select cast('0x' || substr(md5('42:' || user_id), 1, 8) as bigint)
           % least(3, (select count(distinct user_id) from scores)) as fold,
         sqrt(avg(score * score)) as rms
  from scores where score > 0 group by 1)""",
        """
select round(avg(rms), 4) as rmse, count(*) as folds_used from folds""",
    ),
    "order_items_delivered": _with(LINES, "select order_id, product_id from lines"),
    "baskets": _with(
        LINES,
        """
select order_id,
       string_agg(cast(product_id as varchar), ',' order by product_id) as items,
       cast(sum(n_lines) as bigint) as n_lines
from items group by 1""",
    ),
    "basket_profile": _with(
        LINES,
        """
select count(distinct order_id) as total_orders, cast(sum(n_lines) as bigint) as total_items,
       count(distinct product_id) as unique_products,
       round(sum(n_lines) / count(distinct order_id), 2) as avg_items_per_order
from items""",
    ),
    "frequent_items": _with(
        RULES, "select product_id, n_baskets, round(support, 6) as support from frequent"
    ),
    "frequent_pairs": _with(
        RULES, "select item_a, item_b, n_baskets, round(support, 6) as support from pairs"
    ),
    "association_rules": _with(RULES, f"select {RULE_COLUMNS} from rules"),
    "rules_refresh": _with(RULES, f"select {RULE_COLUMNS} from rules"),
    "rules_profile": _with(
        RULES,
        """
select count(*) as n_rules, round(avg(confidence), 4) as avg_confidence,
       round(avg(lift), 4) as avg_lift,
       (select count(*) from frequent) + (select count(*) from pairs) as n_itemsets
from rules""",
    ),
    "fpgrowth_itemsets": "with recursive "
    + LINES.strip()
    + """,
subsets as (
  select order_id, product_id as last, cast(product_id as varchar) as items from items
  union all
  select s.order_id, i.product_id, s.items || ',' || i.product_id
  from subsets s join items i on i.order_id = s.order_id and i.product_id > s.last)
select items, count(*) as n_baskets, round(count(*) / (select n from total), 6) as support
from subsets group by items having count(*) / (select n from total) >= 0.003""",
    "associated_products": _with(ASSOCIATED, "select * from associated"),
    "product_recommendations": _with(
        ASSOCIATED, "select *, confidence as score, 'association' as rec_type from associated"
    ),
    "trending_products": _with(
        SHOP + "," + TRENDING,
        "select product_id, round(score, 6) as score, 'trending' as rec_type from trending",
    ),
    "item_similarity": _with(
        SCORES + "," + SIMILARITY,
        "select item_a, item_b, round(similarity, 6) as similarity from similarity",
    ),
    "item_based_recommendations": _with(
        THIN_LISTS, "select user_id, product_id, score, rank from lists"
    ),
    "homepage_thin_users": _with(
        SCORES + "," + SHOP + "," + SIMILARITY + """,
requested as (
  select user_id from thin union all
  select user_id from users where user_id not in (select user_id from scores)),"""
        + _lists("requested") + "," + TRENDING + "," + HOMEPAGE,
        "select user_id, product_id, round(score, 6) as score, rank, rec_type from homepage",
    ),
    "recommendations_upsert": _with(
        SCORES + "," + SHOP + "," + SIMILARITY + ",\nrequested as (select user_id from thin),"
        + _lists("requested") + "," + TRENDING + "," + HOMEPAGE + """,
stored as (
  select user_id, product_id, score,
         case when score > 5 then 'collaborative' else 'trending' end as rec_type
  from scores),
touched as (
  select distinct r.user_id, coalesce(h.rec_type, 'trending') as rec_type
  from requested r left join homepage h on h.user_id = r.user_id)""",
        """
select user_id, product_id, round(score, 6) as score, rec_type from stored s
where not exists (select 1 from touched t
                  where t.user_id = s.user_id and t.rec_type = s.rec_type)
union all
select user_id, product_id, round(score, 6), rec_type from homepage""",
    ),
    "user_features": _with(
        FEATURES,
        """
select user_id, total_orders, round(total_spent, 6) as total_spent,
       round(avg_order_value, 6) as avg_order_value, days_since_last_order, account_age_days,
       round(purchase_frequency, 6) as purchase_frequency
from user_features""",
    ),
    "user_feature_profile": _with(FEATURES, _PROFILE),
    "scaled_features": _with(FEATURES, f"select user_id, {_SCALED} from user_features"),
    "cluster_profile": _with(
        LABELS,
        """
select cast(cluster as bigint) as cluster, round(total_orders, 6) as total_orders,
       round(total_spent, 6) as total_spent, round(avg_order_value, 6) as avg_order_value,
       round(days_since_last_order, 6) as days_since_last_order,
       round(purchase_frequency, 6) as purchase_frequency
from profile""",
    ),
    "segment_labels": _with(LABELS, "select segment_id, code, name, description from labels"),
    "segment_rollup": _with(
        LABELS,
        """
select l.segment_id, l.name, l.description, count(m.user_id) as user_count
from labels l left join membership m on m.segment_id = l.segment_id group by 1, 2, 3""",
    ),
    "user_segment_lookup": _with(
        LABELS,
        """
select u.user_id, m.segment_id, l.name as segment_name
from users u left join membership m on m.user_id = u.user_id
left join labels l on l.segment_id = m.segment_id""",
    ),
    "repurchase_gaps": _with(
        HISTORY,
        f"select {LINE_COLUMNS}, round(weight_gram, 6) as weight_gram, days_between from gaps",
    ),
    "repurchase_gap_profile": _with(
        HISTORY,
        """
select count(*) as total_samples, count(distinct user_id) as unique_users,
       count(distinct product_id) as unique_products, round(avg(days_between), 2) as mean_days,
       min(days_between) as min_days, max(days_between) as max_days,
       round(quantile_cont(days_between, 0.5), 2) as median_days
from gaps""",
    ),
    "repurchase_pair_state": _with(
        HISTORY,
        f"""
select user_id, product_id, weight_gram, {TIME.format('last_purchase')},
       round(avg_quantity, 6) as avg_quantity
from pair_state""",
    ),
    "repurchase_cycles": _with(
        HISTORY,
        "select user_id, product_id, round(avg_days_between, 6) as avg_days_between from cycles",
    ),
    "product_encoder": _with(HISTORY, "select product_id, product_code from encoder"),
    "repurchase_training_features": _with(
        HISTORY,
        f"""
select {LINE_COLUMNS}, round(weight_gram, 6) as weight_gram, product_code,
       round(avg_days_between, 6) as avg_days_between, days_between
from training""",
    ),
    "repurchase_split": _with(
        HISTORY,
        f"""
select {LINE_COLUMNS},
       cast('0x' || substr(md5('42:' || order_id || ':' || line_no || ':' || tie_1 || ':' || tie_2
                               || ':' || cast(quantity as bigint)), 1, 8) as bigint) % 5 = 0
         as is_test
from training""",
    ),
    "repurchase_serving_features": _with(
        HISTORY,
        f"""
select user_id, product_id, {TIME.format('last_purchase')}, round(quantity, 6) as quantity,
       round(weight_gram, 6) as weight_gram, product_code,
       round(avg_days_between, 6) as avg_days_between
from serving""",
    ),
    "repurchase_due_dates": _with(
        PREDICTIONS, f"select {PREDICTION_COLUMNS}, notified from predictions"
    ),
    "upcoming_repurchases": _with(
        PREDICTIONS,
        f"""
select {PREDICTION_COLUMNS}, product_name,
       row_number() over (partition by user_id order by predicted_date, product_id) as position
from (select p.*, n.name as product_name from predictions p
      join products n on n.product_id = p.product_id
      where p.predicted_date between date '2001-08-02' and date '2001-08-02' + 7)""",
    ),
    "repurchase_notifications": _with(
        PREDICTIONS,
        f"""
select user_id, '{C.REMINDER_TYPE}' as type, '{C.REMINDER_TITLE}' as title,
       'Sản phẩm ''' || product_name || ''' của bạn sắp hết. Dự kiến bạn cần mua lại vào ngày '
         || strftime(predicted_date, '%Y-%m-%d') || '.' as message,
       product_id as ref_id
from due""",
    ),
    "predictions_marked": _with(
        PREDICTIONS,
        f"""
select {PREDICTION_COLUMNS},
       exists (select 1 from due d where d.user_id = p.user_id and d.product_id = p.product_id)
         as notified
from predictions p""",
    ),
    "training_gates": _with(
        SCORES + "," + HISTORY + """,
baskets as (
  select count(distinct d.order_id) as n
  from order_items i join delivered d on d.order_id = i.order_id),
observed(model, requirement, observed, required) as (
  select 'collaborative', 'logs', cast(sum(n_events) as bigint), 1 from scores
  union all select 'collaborative', 'users', count(distinct user_id), 2 from scores
  union all select 'collaborative', 'products', count(distinct product_id), 2 from scores
  union all select 'association', 'baskets', n, 10 from baskets
  union all select 'clustering', 'users', count(*), 4 from users
            where role = 'customer' and is_active
  union all select 'repurchase', 'gaps', count(*), 20 from gaps)""",
        """
select model, requirement, observed, cast(required as bigint) as required,
       observed >= required as ok
from observed""",
    ),
}

ORACLES["interaction_rows"] = _with(
    SCORES,
    """
select user_id, string_agg(cast(product_id as varchar), ',' order by product_id) as products,
       count(*) as n_products, round(sum((product_id + 1) * score), 6) as by_product
from scores group by user_id""",
)

# Ways of storing that must not change what is stored.
ORACLES |= {
    "recommendations_stored": ORACLES["recommendations_upsert"],
    "predictions_marked_in_place": ORACLES["predictions_marked"],
    "segments_committed": ORACLES["segment_rollup"],
    "streamed_scores": ORACLES["interaction_scores"],
    "daily_logs_since": ORACLES["behavior_logs_since"],
}
