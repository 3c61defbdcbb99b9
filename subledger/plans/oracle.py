"""Equivalent SQL per registered query, for a second engine on the same tables.

Written row by row and join by join, without the pre-folding the DataFrame side
uses, so that agreement means something.  Common table expressions are joined from
``PARTS``; ``sql(body, *parts)`` prefixes a body with what it needs.
"""

from subledger.functions import model_values as m

UNIT = "(('0x' || substr(sha256({payload}), 1, 16))::ubigint::double / 18446744073709551616)"


def unit(*parts: str) -> str:
    payload = " || '|' || ".join(f"coalesce(cast({p} as varchar), '')" for p in parts)
    return UNIT.format(payload=payload)


def exact(expression: str) -> str:
    """A double as the decimal it prints as."""
    return f"cast(cast({expression} as varchar) as decimal(28,10))"


def double_of(total: str) -> str:
    """The double nearest to a sum of such decimals."""
    return f"cast(cast({total} as varchar) as double)"


def clamp(expression: str, low: float, high: float) -> str:
    return f"greatest({low}::double, least({high}::double, {expression}))"


SIGNAL = f"least(ln(1 + greatest(total_spend, 0.0::double)) / {m.SPEND_LOG_SCALE}::double, 1.0::double)"

ENROLL = clamp(
    f"{m.ENROLL_BASE}::double"
    f" + least(order_count - 1, {m.ENROLL_REPEAT_ORDERS_COUNTED}) * {m.ENROLL_PER_REPEAT_ORDER}::double"
    f" - greatest(avg_delivery_delay_days, 0.0::double) * {m.ENROLL_PER_DELAY_DAY}::double"
    f" + {SIGNAL} * {m.ENROLL_SPEND_WEIGHT}::double",
    m.ENROLL_MIN,
    m.ENROLL_MAX,
)


def renew(cycle: str) -> str:
    return clamp(
        f"{m.RENEW_BASE}::double"
        f" + least(order_count - 1, {m.RENEW_REPEAT_ORDERS_COUNTED}) * {m.RENEW_PER_REPEAT_ORDER}::double"
        f" - greatest(avg_delivery_delay_days, 0.0::double) * {m.RENEW_PER_DELAY_DAY}::double"
        f" + {SIGNAL} * {m.RENEW_SPEND_WEIGHT}::double"
        f" + ({m.CADENCE_MAX_DAYS} - cadence_days)::double / {m.RENEW_CADENCE_SPAN_DAYS}::double"
        f" * {m.RENEW_CADENCE_WEIGHT}::double"
        f" - greatest({cycle} - {m.RENEW_FREE_CYCLES}, 0) * {m.RENEW_PER_LATE_CYCLE}::double",
        m.RENEW_MIN,
        m.RENEW_MAX,
    )


CADENCE = f"cast(greatest({m.CADENCE_MIN_DAYS}, least({m.CADENCE_MAX_DAYS}, round_even({{}}, 0))) as integer)"


def _features(
    prefix: str, orders: str = "r_orders", payments: str = "r_payments", elapsed: bool = False
) -> str:
    if elapsed:
        gap = "cast(floor((epoch_us(later.bought) - epoch_us(earlier.bought)) / 86400000000.0::double) as integer)"
        late, per_day = "epoch_us(arrived) - epoch_us(due)", "86400000000.0"
    else:
        gap = "date_diff('day', earlier.bought, later.bought)"
        late, per_day = "date_diff('day', due, arrived)", "1.0"
    return f"""
{prefix}_pay as (
  select order_id, {double_of('sum('+exact('payment_value')+')')} as payment_value
  from {payments} group by order_id
), {prefix}_rows as (
  select *, row_number() over (partition by customer_unique_id order by bought, order_id) as nth
  from (select customer_unique_id, customer_state, order_id, order_purchase_timestamp as bought,
               {exact('coalesce(payment_value, 0)')} as amount,
               order_delivered_customer_date as arrived, order_estimated_delivery_date as due
        from r_customers join {orders} using (customer_id) left join {prefix}_pay using (order_id)
        where order_status = 'delivered') delivered
  where bought is not null
), {prefix}_gaps as (
  select later.customer_unique_id, {gap} as gap_days
  from {prefix}_rows later join {prefix}_rows earlier
    on earlier.customer_unique_id = later.customer_unique_id and earlier.nth = later.nth - 1
), {prefix}_cadence as (
  select customer_unique_id, median(gap_days) as observed_cadence_days
  from {prefix}_gaps where gap_days > 0 group by customer_unique_id
), {prefix}_totals as (
  select customer_unique_id, cast(min(bought) as date) as first_order_date,
         arg_min(customer_state, (bought, customer_state)) as customer_state,
         count(distinct order_id) as order_count, count(*) as n, {double_of('sum(amount)')} as total_spend,
         cast(sum(case when {late} > 0 then {late} else 0 end) as bigint) as late
  from {prefix}_rows group by customer_unique_id
), {prefix} as (
  select customer_unique_id, customer_state, first_order_date, order_count,
         total_spend / n as avg_order_value, total_spend,
         late / {per_day}::double / n as avg_delivery_delay_days, observed_cadence_days
  from {prefix}_totals left join {prefix}_cadence using (customer_unique_id)
)"""


def _thresholds(features: str, out: str) -> str:
    typical = f"coalesce(round_even(median(observed_cadence_days) filter (where observed_cadence_days > 0), 0), {m.CADENCE_DEFAULT_DAYS})"
    return f"""
{out} as (
  select quantile_cont(total_spend, 0.25) as q1, quantile_cont(total_spend, 0.5) as q2,
         quantile_cont(total_spend, 0.75) as q3, {CADENCE.format(typical)} as fallback_cadence_days
  from {features}
)"""


def _profiles(features: str, thresholds: str, out: str) -> str:
    return f"""
{out} as (
  select customer_unique_id, first_order_date, cast(order_count as integer) as order_count,
         avg_order_value, total_spend, avg_delivery_delay_days,
         coalesce(nullif(customer_state, ''), 'UNKNOWN') as customer_state,
         coalesce(case when observed_cadence_days is not null
                       then {CADENCE.format('observed_cadence_days')} end,
                  fallback_cadence_days) as cadence_days,
         case when total_spend <= q1 then 'value_1' when total_spend <= q2 then 'value_2'
              when total_spend <= q3 then 'value_3' else 'value_4' end as value_segment
  from {features} cross join {thresholds}
)"""


def _cycles(profiles: str, out: str) -> str:
    return f"""
{out}_enrolled as (
  select * from {profiles} where {unit('customer_unique_id', "'enroll'")} < {ENROLL}
), {out}_draws as (
  select e.*, k, k = 1 or {unit('customer_unique_id', "'renew'", 'k')} < {renew('k')} as holds
  from {out}_enrolled e cross join (select unnest(range(1, {m.MAX_CYCLES + 1})) as k) cycle_numbers
), {out}_states as (
  select *, min(case when not holds then k end) over (partition by customer_unique_id) as lapse
  from {out}_draws
), {out} as (
  select 'sub_' || customer_unique_id as subscription_id, customer_unique_id,
         cast(k as integer) as cycle_number,
         cast(first_order_date + cast(cadence_days * (k - 1) as integer) as date) as billing_date,
         case when lapse is null or k < lapse
              then cast(floor(greatest(avg_order_value, {m.MIN_BILLING_AMOUNT}::double) * 100 + 0.5::double) as bigint)
                   / 100.0::double
              else 0.0::double end as billing_amount,
         case when lapse is null or k < lapse then 1 else 0 end as renewed,
         case when k = lapse then 1 else 0 end as churned_this_cycle,
         customer_state, value_segment, cadence_days
  from {out}_states where lapse is null or k <= lapse
)"""


def _retention(cycles: str, key: str, out: str) -> str:
    return f"""
{out}_active as (
  select {key}, cycle_number, count(*) as n
  from (select distinct {key}, cycle_number, subscription_id from {cycles} where renewed = 1) pairs
  group by {key}, cycle_number
), {out} as (
  select shown.{key}, shown.cycle_number, started.n as cohort_size,
         coalesce(kept.n, 0) as retained_subscribers,
         round(coalesce(kept.n, 0) / started.n, 4) as retention_rate
  from (select distinct {key}, cycle_number from {cycles}) shown
  join {out}_active started on started.{key} = shown.{key} and started.cycle_number = 1
  left join {out}_active kept on kept.{key} = shown.{key} and kept.cycle_number = shown.cycle_number
)"""


def _by_subscription(cycles: str, out: str) -> str:
    return f"""
{out} as (
  select subscription_id, count(*) as cycle_rows, max(cycle_number) as cycles_observed,
         sum({exact('billing_amount')}) as ltv,
         max(churned_this_cycle) as churned
  from {cycles} group by subscription_id
)"""


def _segments(cycles: str, out: str) -> str:
    return f"""
{out} as (
  select *, retained_subscribers::double / cohort_size as retention_rate
  from (select value_segment, count(distinct subscription_id) filter (where cycle_number = 1) as cohort_size,
               count(*) filter (where cycle_number = 3) as retained_subscribers
        from (select distinct value_segment, cycle_number, subscription_id
              from {cycles} where renewed = 1) active
        group by value_segment) sized
  where cohort_size > 0
)"""


def _spread(segments: str, out: str) -> str:
    return f"""
{out} as (
  select count(*) as customer_segments,
         round_even((max(retention_rate) - min(retention_rate)) * 100, 1) as retention_variance_pct_points,
         first(value_segment order by retention_rate desc, value_segment) as best_segment,
         round_even(max(retention_rate) * 100, 1) as best_segment_retention_pct,
         first(value_segment order by retention_rate, value_segment) as worst_segment,
         round_even(min(retention_rate) * 100, 1) as worst_segment_retention_pct
  from {segments} where cohort_size >= {m.MIN_COHORT_SIZE}
)"""


def _summary(orders: str, payments: str, by_sub: str, spread: str, out: str) -> str:
    return f"""
{out} as (
  select (select count(*) from {orders}) as real_orders,
         (select count(*) from {payments}) as real_payment_records,
         (select count(*) from r_order_items) as real_order_items,
         s.synthetic_subscribers, s.synthetic_billing_cycles,
         p.customer_segments, 3 as retention_cycle, p.retention_variance_pct_points,
         p.best_segment, p.best_segment_retention_pct,
         p.worst_segment, p.worst_segment_retention_pct,
         s.synthetic_churn_rate_pct, s.synthetic_avg_ltv_brl
  from (select count(*) as synthetic_subscribers,
               cast(sum(cycle_rows) as bigint) as synthetic_billing_cycles,
               round_even(avg(churned) * 100, 1) as synthetic_churn_rate_pct,
               round_even({double_of('sum(ltv)')} / count(*), 2)
                 as synthetic_avg_ltv_brl
        from {by_sub}) s cross join {spread} p
)"""


PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "r_customers": ((), """
r_customers as (
  select cast(c_custkey as varchar) as customer_id,
         cast(case when c_custkey % 10 = 1 then c_custkey - 1 else c_custkey end as varchar)
           as customer_unique_id,
         c_nationkey as customer_zip_code_prefix, c_name as customer_city, n_name as customer_state
  from customer join nation on c_nationkey = n_nationkey
)"""),
    "r_orders": ((), """
r_shipped as (
  select l_orderkey, max(l_shipdate) as last_ship from lineitem group by l_orderkey
), r_orders as (
  select cast(o_orderkey as varchar) as order_id, cast(o_custkey as varchar) as customer_id,
         case o_orderstatus when 'F' then 'delivered' when 'O' then 'shipped' else 'processing' end
           as order_status,
         o_orderdate as order_purchase_timestamp, o_orderdate as order_approved_at,
         o_orderdate + to_days(cast(((date_diff('day', o_orderdate, last_ship) % 45) + 45) % 45 as integer))
           as order_delivered_carrier_date,
         o_orderdate + to_days(cast(((date_diff('day', o_orderdate, last_ship) % 45) + 45) % 45 as integer))
           as order_delivered_customer_date,
         o_orderdate + to_days(30) as order_estimated_delivery_date
  from orders left join r_shipped on o_orderkey = l_orderkey
)"""),
    "r_payments": ((), """
r_payments as (
  select cast(l_orderkey as varchar) as order_id, l_linenumber as payment_sequential,
         l_returnflag as payment_type, l_linenumber as payment_installments,
         round(l_extendedprice * (1 - l_discount) * (1 + l_tax) / 100, 2) as payment_value
  from lineitem
)"""),
    "r_order_items": ((), """
r_order_items as (
  select cast(l_orderkey as varchar) as order_id, l_linenumber as order_item_id,
         cast(l_partkey as varchar) as product_id, cast(l_suppkey as varchar) as seller_id,
         l_shipdate as shipping_limit_date, l_extendedprice as price,
         l_extendedprice * l_tax as freight_value
  from lineitem
)"""),
    "r_products": ((), """
r_products as (
  select cast(p_partkey as varchar) as product_id, p_type as product_category_name,
         cast(length(p_name) as integer) as product_name_length,
         cast(length(p_brand) as integer) as product_description_length,
         p_size as product_photos_qty, p_retailprice as product_weight_g
  from part
)"""),
    "r_reviews": ((), """
r_reviews as (
  select cast(event_id as varchar) as review_id, cast(user_id as varchar) as order_id,
         cast(1 + cast(trunc(value) as integer) % 5 as integer) as review_score,
         ts as review_creation_date, ts as review_answer_timestamp
  from events
)"""),
    "r_spine": ((), f"""
r_spine as (
  select cast(month as date) as month, n_name as customer_state, channel, base_spend
  from (select unnest(generate_series(
                 date_trunc('month', (select min(o_orderdate) from orders)),
                 date_trunc('month', (select max(o_orderdate) from orders) + interval 2 month),
                 interval 1 month)) as month) months
  cross join (select n_name from nation) states
  cross join (values {', '.join(f"('{c}', {b})" for c, b in m.CHANNEL_BASE_SPEND.items())})
    as channels(channel, base_spend)
)"""),
    "r_marketing_spend": (("r_spine",), f"""
r_marketing_spend as (
  select month, customer_state, channel,
         round_even(base_spend * (0.75::double + 0.5::double * u), 2) as spend_brl,
         cast(trunc(50000 + 150000 * u) as bigint) as impressions,
         cast(trunc(1000 + 9000 * u) as bigint) as clicks
  from (select *, {unit('month', 'customer_state', 'channel')} as u from r_spine) drawn
)"""),
    "r_catalog_overrides": (("r_products",), f"""
r_catalog_overrides as (
  select product_id,
         case when u > 0.82 then 'premium' when u > 0.28 then 'standard' else 'value' end as catalog_tier,
         case when u > 0.18 then 1 else 0 end as subscription_eligible,
         case when u > 0.70 then 'high' when u > 0.32 then 'mid' else 'low' end as margin_band
  from (select product_id, {unit('product_id', "'catalog'")} as u from r_products) drawn
)"""),
    "e_orders": ((), """
e_orders as (
  select cast(event_id as varchar) as order_id, cast(user_id as varchar) as customer_id,
         case when event_type = 'purchase' then 'delivered' else 'processing' end as order_status,
         ts as order_purchase_timestamp,
         ts + to_seconds(cast(floor(value * 3600) as integer)) as order_delivered_customer_date,
         ts + to_days(2) as order_estimated_delivery_date
  from events
)"""),
    "e_payments": ((), """
e_payments as (
  select cast(event_id as varchar) as order_id, value as payment_value from events
)"""),
    "pay": (("r_payments",), f"""
pay as (
  select order_id, {double_of('sum('+exact('payment_value')+')')} as payment_value
  from r_payments group by order_id
)"""),
    "items": (("r_order_items",), f"""
items as (
  select order_id, count(*) as item_count,
         {double_of('sum('+exact('price')+')')} as item_revenue,
         {double_of('sum('+exact('freight_value')+')')}
           as freight_value
  from r_order_items group by order_id
)"""),
    "facts": (("r_orders", "r_customers", "pay", "items"), """
facts as (
  select order_id, customer_unique_id, customer_state, order_status, order_purchase_timestamp,
         cast(date_trunc('month', order_purchase_timestamp) as date) as order_month,
         coalesce(payment_value, 0) as payment_value, coalesce(item_count, 0) as item_count,
         coalesce(item_revenue, 0) as item_revenue, coalesce(freight_value, 0) as freight_value
  from r_orders join r_customers using (customer_id)
  left join pay using (order_id)
  left join items using (order_id)
)"""),
    "revenue": (("facts",), f"""
revenue as (
  select order_month as month, customer_state,
         {double_of('sum('+exact('payment_value')+')')} as observed_revenue_brl,
         count(distinct order_id) as orders
  from facts where order_status = 'delivered' group by 1, 2
)"""),
    "spend": (("r_marketing_spend",), f"""
spend as (
  select month, customer_state,
         {double_of('sum('+exact('spend_brl')+')')} as marketing_spend_brl
  from r_marketing_spend group by 1, 2
)"""),
    "efficiency": (("revenue", "spend"), """
efficiency as (
  select month, customer_state, cast(sum(n) as bigint) as orders, sum(earned) as observed_revenue_brl,
         sum(spent) as marketing_spend_brl,
         case when sum(spent) <> 0 then round(sum(earned) / sum(spent), 3) end as modeled_roas
  from (select month, customer_state, orders as n, observed_revenue_brl as earned, 0::double as spent
        from revenue
        union all
        select month, customer_state, 0, 0, marketing_spend_brl from spend) sides
  group by month, customer_state
)"""),
    "features": (("r_orders", "r_payments", "r_customers"), _features("features")),
    "thresholds": (("features",), _thresholds("features", "thresholds")),
    "profiles": (("features", "thresholds"), _profiles("features", "thresholds", "profiles")),
    "cycles": (("profiles",), _cycles("profiles", "cycles")),
    "by_sub": (("cycles",), _by_subscription("cycles", "by_sub")),
    "segments": (("cycles",), _segments("cycles", "segments")),
    "spread": (("segments",), _spread("segments", "spread")),
    "summary": (
        ("r_orders", "r_payments", "r_order_items", "by_sub", "spread"),
        _summary("r_orders", "r_payments", "by_sub", "spread", "summary"),
    ),
    "ef": (
        ("e_orders", "e_payments", "r_customers"),
        _features("ef", "e_orders", "e_payments", elapsed=True),
    ),
    "ec": (
        ("e_orders", "e_payments", "r_customers"),
        _features("ec", "e_orders", "e_payments", elapsed=False),
    ),
    "segment_mart": (("cycles",), _retention("cycles", "value_segment", "segment_mart")),
    "cohort_base": (("cycles",), """
cohort_base as (
  select subscription_id, cycle_number, renewed, cast(date_trunc('month', first_bill) as date) as cohort_month
  from cycles
  join (select subscription_id, min(billing_date) as first_bill from cycles group by subscription_id) started
    using (subscription_id)
)"""),
    "cohort_sizes": (("cohort_base",), """
cohort_sizes as (
  select cohort_month, count(distinct subscription_id) as cohort_size
  from cohort_base where cycle_number = 1 and renewed = 1 group by 1
)"""),
    "cohort_mart": (("cohort_base",), _retention("cohort_base", "cohort_month", "cohort_mart")),
    "kpis": (("by_sub",), f"""
kpis as (
  select count(*) as synthetic_subscribers,
         sum(case when churned = 0 then 1 else 0 end)::bigint as active_subscriptions,
         round(avg(churned), 4) as churn_rate,
         round({double_of('sum(ltv)')} / count(*), 2) as avg_ltv_brl,
         round({double_of('sum(ltv)')}, 2) as synthetic_recurring_revenue_brl,
         round(avg(cycles_observed), 2) as avg_cycles_observed
  from by_sub
)"""),
    "ltv": (("cycles",), f"""
ltv as (
  select subscription_id, customer_unique_id, min(value_segment) as value_segment,
         {double_of('sum('+exact('billing_amount')+')')} as synthetic_ltv_brl,
         sum(renewed)::bigint as active_cycles, max(churned_this_cycle) as churned
  from cycles group by subscription_id, customer_unique_id
)"""),
    "person_facts": (("facts",), f"""
person_facts as (
  select customer_unique_id,
         arg_min(customer_state, (order_purchase_timestamp, customer_state)) as customer_state,
         min(cast(order_purchase_timestamp as date)) as first_order_date,
         count(distinct order_id) as order_count,
         {double_of('sum('+exact('payment_value')+')')} as observed_revenue,
         {double_of('sum('+exact('payment_value')+')')} / count(payment_value)
           as avg_order_value
  from facts where order_status = 'delivered' group by 1
)"""),
}

# The metric record whatever the size of the cohorts.
PARTS["any_spread"] = (
    ("segments",),
    _spread("segments", "any_spread").replace(f"cohort_size >= {m.MIN_COHORT_SIZE}", "cohort_size >= 1"),
)
PARTS["any_summary"] = (
    ("r_orders", "r_payments", "r_order_items", "by_sub", "any_spread"),
    _summary("r_orders", "r_payments", "by_sub", "any_spread", "any_summary"),
)

# The metric record under both day semantics, over the event shop.
for _tag, _features_name in (("x", "ec"), ("y", "ef")):
    PARTS[f"{_tag}_thresholds"] = ((_features_name,), _thresholds(_features_name, f"{_tag}_thresholds"))
    PARTS[f"{_tag}_profiles"] = (
        (_features_name, f"{_tag}_thresholds"),
        _profiles(_features_name, f"{_tag}_thresholds", f"{_tag}_profiles"),
    )
    PARTS[f"{_tag}_cycles"] = ((f"{_tag}_profiles",), _cycles(f"{_tag}_profiles", f"{_tag}_cycles"))
    PARTS[f"{_tag}_by_sub"] = ((f"{_tag}_cycles",), _by_subscription(f"{_tag}_cycles", f"{_tag}_by_sub"))
    PARTS[f"{_tag}_segments"] = ((f"{_tag}_cycles",), _segments(f"{_tag}_cycles", f"{_tag}_segments"))
    PARTS[f"{_tag}_spread"] = (
        (f"{_tag}_segments",),
        _spread(f"{_tag}_segments", f"{_tag}_spread").replace(
            f"cohort_size >= {m.MIN_COHORT_SIZE}", "cohort_size >= 1"
        ),
    )
    PARTS[f"{_tag}_summary"] = (
        ("e_orders", "e_payments", "r_order_items", f"{_tag}_by_sub", f"{_tag}_spread"),
        _summary("e_orders", "e_payments", f"{_tag}_by_sub", f"{_tag}_spread", f"{_tag}_summary"),
    )


def _needed(names: tuple[str, ...], seen: list[str]) -> list[str]:
    for name in names:
        if name not in seen:
            _needed(PARTS[name][0], seen)
            if name not in seen:
                seen.append(name)
    return seen


def sql(body: str, *parts: str) -> str:
    wanted = _needed(parts, [])
    if not wanted:
        return body
    return "with " + ", ".join(PARTS[name][1].strip() for name in wanted) + "\n" + body


def counts(tables: dict[str, str], name: str, value: str) -> str:
    return " union all ".join(
        f"select '{label}' as {name}, count(*) as {value} from {table}" for label, table in tables.items()
    )


RAW = {
    "customers": "r_customers",
    "orders": "r_orders",
    "order_items": "r_order_items",
    "payments": "r_payments",
    "products": "r_products",
    "reviews": "r_reviews",
    "category_translation": "region",
    "marketing_spend": "r_marketing_spend",
    "catalog_overrides": "r_catalog_overrides",
}
RAW_PARTS = tuple(p for p in RAW.values() if p != "region")
RAW_WIDTHS = {
    "customers": 5,
    "orders": 8,
    "order_items": 7,
    "payments": 5,
    "products": 6,
    "reviews": 6,
    "category_translation": 2,
    "marketing_spend": 6,
    "catalog_overrides": 4,
}


def _distinct(table: str) -> str:
    return f"(select distinct * from {table})"


def _audit() -> str:
    """The reviews are written with copies and with words for some scores."""
    number = "cast(review_id as bigint)"
    spoiled = f"(select *, {number} % 89 = 0 as bad, case when {number} % 31 = 0 then 2 else 1 end as n from r_reviews)"
    return " union all ".join(
        f"select '{name}' as name, cast(sum(n) as bigint) as records, count(*) filter (not bad) as rows,"
        f" coalesce(cast(sum(n - 1) filter (not bad) as bigint), 0) as duplicates,"
        f" coalesce(cast(sum(n) filter (bad) as bigint), 0) as rejects,"
        f" {RAW_WIDTHS[name]} as columns, '{name}' as source"
        f" from {spoiled if name == 'reviews' else f'(select *, false as bad, 1 as n from {_distinct(table)}) t'}"
        for name, table in RAW.items()
    )


def _check(name: str, violating: str) -> str:
    return (
        f"select '{name}' as \"check\", count(*) as violations,"
        f" case when count(*) = 0 then 1 else 0 end as passed from ({violating}) v"
    )


def _unpivot(record: str, prefix: str) -> str:
    numbers = [
        "real_orders", "real_payment_records", "real_order_items", "synthetic_subscribers",
        "synthetic_billing_cycles", "customer_segments", "retention_cycle",
        "retention_variance_pct_points", "best_segment_retention_pct",
        "worst_segment_retention_pct", "synthetic_churn_rate_pct", "synthetic_avg_ltv_brl",
    ]
    rows = [
        f"select '{n}' as metric, {n}::double as {prefix}_value, null::varchar as {prefix}_label from {record}"
        for n in numbers
    ] + [
        f"select '{n}' as metric, null::double as {prefix}_value, {n} as {prefix}_label from {record}"
        for n in ("best_segment", "worst_segment")
    ]
    return " union all ".join(rows)


NOT_NULL = {
    "stg_customers": ("r_customers", ["customer_id", "customer_unique_id"]),
    "stg_orders": ("r_orders", ["order_id"]),
    "stg_payments": ("r_payments", ["payment_value"]),
    "stg_subscription_cycles": ("cycles", ["subscription_id", "cycle_number", "billing_amount"]),
    "mart_cohort_retention": ("cohort_mart", ["retention_rate"]),
    "mart_segment_retention": ("segment_mart", ["retention_rate"]),
}

MODELS = {
    "stg_customers": "r_customers",
    "stg_orders": "r_orders",
    "stg_order_items": "r_order_items",
    "stg_payments": "r_payments",
    "stg_products": "r_products",
    "stg_reviews": "r_reviews",
    "stg_marketing_spend": "r_marketing_spend",
    "stg_catalog_overrides": "r_catalog_overrides",
    "stg_subscription_cycles": "cycles",
    "int_order_facts": "facts",
    "int_customer_features": "person_facts",
    "mart_subscription_kpis": "kpis",
    "mart_customer_ltv": "ltv",
    "mart_cohort_retention": "cohort_mart",
    "mart_segment_retention": "segment_mart",
    "mart_marketing_efficiency": "efficiency",
    "order_rows": "facts",
    "customer_days": (
        "(select distinct customer_unique_id, customer_state, cast(bought as date) as day from features_rows) days"
    ),
    "customer_features": "features",
    "customer_profiles": "profiles",
    "subscription_cycles": "cycles",
    "segment_retention_cycle3": "segments",
}
MODEL_PARTS = [part for part in MODELS.values() if part in PARTS]
WRITTEN = ("order_rows", "customer_days", "customer_features", "subscription_cycles", "segment_retention_cycle3")


def oracle_sql() -> dict[str, str]:
    score_columns = "customer_unique_id, order_count, avg_delivery_delay_days, total_spend"
    segment_columns = "value_segment, cycle_number, cohort_size, retained_subscribers, retention_rate"
    cohort_columns = segment_columns.replace("value_segment", "cohort_month")
    # quality
    check_bodies = {
        "dq_not_null": " union all ".join(
            _check(f"{table}.{c} not null", f"select 1 from {source} where {c} is null")
            for table, (source, columns) in NOT_NULL.items()
            for c in columns
        ),
        "dq_unique": (
            _check("stg_customers.customer_id unique",
                   "select customer_id from r_customers group by 1 having count(*) > 1")
            + " union all "
            + _check("stg_orders.order_id unique",
                     "select order_id from r_orders group by 1 having count(*) > 1")
        ),
        "dq_accepted_values": _check(
            "stg_orders.order_status accepted",
            "select order_status from r_orders where order_status not in ("
            + ", ".join(f"'{s}'" for s in m.ORDER_STATUSES)
            + ") group by 1",
        ),
        "dq_non_negative": (
            _check("stg_subscription_cycles.billing_amount non-negative",
                   "select 1 from cycles where billing_amount < 0")
            + " union all "
            + _check("stg_payments.payment_value non-negative",
                     "select 1 from r_payments where payment_value < 0")
        ),
        "dq_rate_bounds": _check(
            "mart_segment_retention.retention_rate in [0, 1]",
            "select 1 from segment_mart where retention_rate < 0 or retention_rate > 1",
        ),
        "dq_unique_cycle": _check(
            "stg_subscription_cycles (subscription_id, cycle_number) unique",
            "select subscription_id, cycle_number from cycles group by 1, 2 having count(*) > 1",
        ),
    }
    check_parts = {
        "dq_not_null": ("r_customers", "r_orders", "r_payments", "cycles", "cohort_mart", "segment_mart"),
        "dq_unique": ("r_customers", "r_orders"),
        "dq_accepted_values": ("r_orders",),
        "dq_non_negative": ("cycles", "r_payments"),
        "dq_rate_bounds": ("segment_mart",),
        "dq_unique_cycle": ("cycles",),
    }
    checks = {name: sql(body, *check_parts[name]) for name, body in check_bodies.items()}
    return {
        # files
        "csv_scan": sql("select distinct * from r_order_items", "r_order_items"),
        "parse_ts_if_present": (
            "select event_id, case when event_id % 7 = 0 then null else ts end as ts from events"
        ),
        "dedupe_rows": "select distinct * from (select * from lineitem union all select * from lineitem)",
        "bronze_write": sql("select * from r_payments", "r_payments"),
        "bronze_ingest": sql(
            "select 'orders' as name, count(*) as rows, 0 as duplicates, 0 as rejects, 9 as columns from r_orders",
            "r_orders",
        ),
        "ingest_audit": sql(_audit(), *RAW_PARTS),
        "ingest_rejects": sql(
            "select 'reviews' as source, 'column review_score: no int: five' as reason, order_id, review_id,"
            " 'said \"' || review_id || '\",' || chr(10) || 'then \"left\"' as comment, 'five' as score"
            " from (select *, cast(review_id as bigint) as number from r_reviews) r,"
            " (select unnest([0, 1]) as copy)"
            " where number % 89 = 0 and (copy = 0 or number % 31 = 0)",
            "r_reviews",
        ),
        "parquet_scan": sql(counts(RAW, "name", "rows"), *RAW_PARTS),
        "cycle_table_write": sql("select * from cycles", "cycles"),
        "source_contract": sql(
            "select source, rows, 0 as missing_columns, 1 as passed from ("
            + counts(RAW, "source", "rows")
            + ") counted",
            *RAW_PARTS,
        ),
        "metrics_json_sink": sql("select * from summary", "summary"),
        "csv_sink": sql(
            "select value_segment, retention_rate as cycle3_retention_rate from segments", "segments"
        ),
        "model_materialize": sql(
            f"select model, case when starts_with(model, 'mart_') or model in {WRITTEN} then 'table' else 'view' end"
            " as materialization, rows from (" + counts(MODELS, "model", "rows") + ") counted",
            *MODEL_PARTS,
        ),
        # staging
        "stg_customers": sql("select * from r_customers", "r_customers"),
        "stg_orders": sql("select * from r_orders", "r_orders"),
        "stg_order_items": sql("select * from r_order_items", "r_order_items"),
        "stg_payments": sql("select * from r_payments", "r_payments"),
        "stg_products": sql("select * from r_products", "r_products"),
        "stg_reviews": sql("select * from r_reviews", "r_reviews"),
        "stg_marketing_spend": sql("select * from r_marketing_spend", "r_marketing_spend"),
        "stg_catalog_overrides": sql("select * from r_catalog_overrides", "r_catalog_overrides"),
        "stg_subscription_cycles": sql("select * from cycles", "cycles"),
        # filters
        "delivered_orders": sql(
            "select * from r_orders where order_status = 'delivered'"
            " and order_purchase_timestamp is not null",
            "r_orders",
        ),
        "cycle_anchor": sql(
            "select * from cycles where cycle_number = 3 and renewed = 1", "cycles"
        ),
        "eligible_segments": sql("select * from segments where cohort_size >= 50", "segments"),
        "cycle3_segments": sql(
            "select value_segment, retention_rate from segment_mart where cycle_number = 3",
            "segment_mart",
        ),
        # joins
        "orders_customers": sql(
            "select o.*, c.customer_unique_id, c.customer_state"
            " from r_orders o join r_customers c using (customer_id)",
            "r_orders",
            "r_customers",
        ),
        "orders_payments_left": sql(
            "select o.*, coalesce(p.payment_value, 0.0::double) as payment_value"
            " from r_orders o left join pay p using (order_id)",
            "r_orders",
            "pay",
        ),
        "orders_items_left": sql(
            "select o.*, coalesce(i.item_count, 0) as item_count,"
            " coalesce(i.item_revenue, 0.0::double) as item_revenue,"
            " coalesce(i.freight_value, 0.0::double) as freight_value"
            " from r_orders o left join items i using (order_id)",
            "r_orders",
            "items",
        ),
        "orders_payments_bucketed": sql(
            "select o.*, coalesce(p.payment_value, 0.0::double) as payment_value"
            " from r_orders o left join pay p using (order_id)",
            "r_orders",
            "pay",
        ),
        "orders_items_bucketed": sql(
            "select o.*, coalesce(i.item_count, 0) as item_count,"
            " coalesce(i.item_revenue, 0.0::double) as item_revenue,"
            " coalesce(i.freight_value, 0.0::double) as freight_value"
            " from r_orders o left join items i using (order_id)",
            "r_orders",
            "items",
        ),
        "revenue_spend_full_outer": sql(
            "select month, customer_state, orders, observed_revenue_brl, marketing_spend_brl"
            " from efficiency",
            "efficiency",
        ),
        "cycles_cohort_inner": sql(
            "select s.*, c.cohort_size from cycles s join"
            " (select value_segment, count(distinct subscription_id) as cohort_size from cycles"
            " where cycle_number = 1 and renewed = 1 group by 1) c using (value_segment)",
            "cycles",
        ),
        "cohort_retained_left": sql(
            "select value_segment, cohort_size, retained_subscribers from segments", "segments"
        ),
        "month_state_channel_spine": sql("select * from r_spine", "r_spine"),
        # aggregations
        "payments_by_order": sql("select * from pay", "pay"),
        "items_by_order": sql("select * from items", "items"),
        "int_order_facts": sql("select * from facts", "facts"),
        "customer_features": sql("select * from features", "features"),
        "customer_features_incremental": sql("select * from features", "features"),
        "customer_features_elapsed": sql("select * from ef", "ef"),
        "int_customer_features": sql("select * from person_facts", "person_facts"),
        "spend_quartiles": sql("select q1, q2, q3 from thresholds", "thresholds"),
        "fallback_cadence": sql("select fallback_cadence_days from thresholds", "thresholds"),
        "mart_subscription_kpis": sql("select * from kpis", "kpis"),
        "mart_customer_ltv": sql("select * from ltv", "ltv"),
        "cohort_sizes": sql("select * from cohort_sizes", "cohort_sizes"),
        "mart_segment_retention": sql("select * from segment_mart", "segment_mart"),
        "mart_cohort_retention": sql("select * from cohort_mart", "cohort_mart"),
        "segment_retention_incremental": sql("select * from segment_mart", "segment_mart"),
        "cohort_retention_incremental": sql("select * from cohort_mart", "cohort_mart"),
        "mart_marketing_efficiency": sql("select * from efficiency", "efficiency"),
        "revenue_by_month_state": sql("select * from revenue", "revenue"),
        "spend_by_month_state": sql("select * from spend", "spend"),
        "source_counts": sql(
            counts(
                {
                    "real_orders": "r_orders",
                    "real_payment_records": "r_payments",
                    "real_order_items": "r_order_items",
                    "synthetic_subscribers": "by_sub",
                    "synthetic_billing_cycles": "cycles",
                },
                "metric",
                "value",
            ),
            "r_orders",
            "r_payments",
            "r_order_items",
            "by_sub",
        ),
        "segment_retention_cycle3": sql("select * from segments", "segments"),
        "retention_spread": sql("select * from spread", "spread"),
        "retention_spread_sql": sql(
            "select max(retention_rate) as highest_retention, min(retention_rate) as lowest_retention,"
            " (max(retention_rate) - min(retention_rate)) * 100 as spread_percentage_points"
            " from segment_mart where cycle_number = 3",
            "segment_mart",
        ),
        "churn_rate": sql("select avg(churned) as churn_rate from by_sub", "by_sub"),
        "avg_ltv": sql(
            f"select {double_of('sum(ltv)')} / count(*) as avg_ltv_brl from by_sub",
            "by_sub",
        ),
        "summary_metrics": sql("select * from summary", "summary"),
        "monthly_revenue_vs_spend": sql(
            f"select month, {double_of('sum('+exact('observed_revenue_brl')+')')}"
            " as observed_revenue_brl,"
            f" {double_of('sum('+exact('marketing_spend_brl')+')')}"
            " as mock_marketing_spend_brl from efficiency group by 1",
            "efficiency",
        ),
        "segment_retention_pivot": sql(
            "select cycle_number, "
            + ", ".join(
                f"max(retention_rate) filter (where value_segment = '{s}') as {s}" for s in m.VALUE_SEGMENTS
            )
            + " from segment_mart group by 1",
            "segment_mart",
        ),
        "cohort_curve": sql(
            "select cycle_number, retention_rate from cohort_mart"
            " where cohort_month = (select max(cohort_month) from cohort_mart)",
            "cohort_mart",
        ),
        "cohort_months": sql("select distinct cohort_month from cohort_mart", "cohort_mart"),
        # windows
        "order_gaps": sql(
            "select customer_unique_id, order_id, bought as order_purchase_timestamp,"
            " cast(date_diff('day', (select e.bought from features_rows e"
            " where e.customer_unique_id = l.customer_unique_id and e.nth = l.nth - 1), bought) as integer)"
            " as gap_days from features_rows l",
            "features",
        ),
        "cohort_month": sql("select * from cohort_base", "cohort_base"),
        "order_gaps_elapsed": (
            "select user_id, event_id, ts, cast(floor((epoch_us(ts) - epoch_us(lag(ts) over w))"
            " / 86400000000.0::double) as integer) as gap_days from events"
            " window w as (partition by user_id order by ts, event_id)"
        ),
        # analyst queries
        "segment_curve": sql(f"select {segment_columns} from segment_mart", "segment_mart"),
        "cohort_curve_all": sql(f"select {cohort_columns} from cohort_mart", "cohort_mart"),
        "kpi_snapshot": sql("select * from kpis", "kpis"),
        # model
        "stable_hash_split": f"select event_id, user_id, {unit('user_id', 'event_type', 'event_id')} as u from events",
        "spend_signal": sql(
            f"select customer_unique_id, total_spend, round({SIGNAL}, 9) as spend_signal from profiles",
            "profiles",
        ),
        "enrollment_score": sql(
            f"select {score_columns}, round({ENROLL}, 9) as enrollment_score from profiles", "profiles"
        ),
        "renewal_score": sql(
            f"select {score_columns}, cadence_days, cast(k as integer) as cycle_number,"
            f" round({renew('k')}, 9) as renewal_score from profiles"
            f" cross join (select unnest(range(2, {m.MAX_CYCLES + 1})) as k) cycle_numbers",
            "profiles",
        ),
        "enrolled_customers": sql(
            f"select * from profiles where {unit('customer_unique_id', chr(39) + 'enroll' + chr(39))} < {ENROLL}",
            "profiles",
        ),
        "cadence_days": sql("select customer_unique_id, cadence_days from profiles", "profiles"),
        "value_segment": sql(
            "select customer_unique_id, total_spend, value_segment from profiles", "profiles"
        ),
        "customer_profiles": sql("select * from profiles", "profiles"),
        "billing_cycles": sql("select * from cycles", "cycles"),
        "marketing_spend": sql("select * from r_marketing_spend", "r_marketing_spend"),
        "catalog_tiers": sql("select * from r_catalog_overrides", "r_catalog_overrides"),
        **checks,
        "quality_report": sql(
            " union all ".join(check_bodies.values()),
            "r_customers", "r_orders", "r_payments", "cycles", "cohort_mart", "segment_mart",
        ),
        "dq_metric_gates": sql(
            "select 'enough orders' as \"check\", case when real_orders > 90000 then 1 else 0 end as passed"
            " from summary union all select 'two or more segments',"
            " case when customer_segments >= 2 then 1 else 0 end from summary"
            " union all select 'any subscribers',"
            " case when synthetic_subscribers > 0 then 1 else 0 end from summary",
            "summary",
        ),
        "metrics_recount": sql(
            "select metric, pipeline_value, pipeline_label, pipeline_value as crosscheck_value,"
            " pipeline_label as crosscheck_label,"
            " case when pipeline_value is not null then 0.0::double end as difference, 1 as agrees"
            f" from ({_unpivot('any_summary', 'pipeline')}) a",
            "any_summary",
        ),
        "metrics_crosscheck": sql(
            "select a.metric, pipeline_value, pipeline_label, crosscheck_value, crosscheck_label,"
            " crosscheck_value - pipeline_value as difference,"
            " case when pipeline_value is not distinct from crosscheck_value"
            " and pipeline_label is not distinct from crosscheck_label then 1 else 0 end as agrees"
            f" from ({_unpivot('x_summary', 'pipeline')}) a"
            f" full join ({_unpivot('y_summary', 'crosscheck')}) b on a.metric = b.metric",
            "x_summary",
            "y_summary",
        ),
    }
