"""Models over the driver's tables, in DuckDB's dialect; Spark gets them through the dialect rewrites.

Money is summed as decimals, so sums don't depend on the order of rows.
``SOURCES`` are the raw tables, ``MODELS`` the SQL by name. A model's oracle is
the chain of its ancestors as CTEs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tributary.functions.dialect import relations, to_spark
from tributary.plans.lineage import topological

SOURCES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

MODELS = {
    "stg_customers": """
select
    c_custkey as customer_id,
    lower(trim(c_name)) as customer_name,
    c_nationkey as nation_id,
    c_acctbal as balance,
    lower(trim(c_mktsegment)) as segment
from customer""",
    "stg_orders": """
select
    o_orderkey as order_id,
    o_custkey as customer_id,
    o_orderstatus as status,
    o_totalprice as total_price,
    cast(o_orderdate as date) as order_date,
    o_orderpriority as priority
from orders""",
    "stg_items": """
select
    l_orderkey as order_id,
    l_linenumber as line_number,
    l_partkey as part_id,
    l_suppkey as supplier_id,
    l_quantity as quantity,
    l_extendedprice as price,
    l_discount as discount,
    l_returnflag as return_flag,
    cast(l_shipdate as date) as ship_date
from lineitem""",
    "stg_parts": """
select p_partkey as part_id, p_name as part_name, upper(p_brand) as brand, p_type as part_type, p_size as size, p_retailprice as retail_price
from part""",
    "stg_events": """
select event_id, ts, user_id, lower(event_type) as event_type, value
from events
where user_id is not null""",
    "int_items_enriched": """
select
    items.order_id,
    items.line_number,
    items.part_id,
    parts.brand,
    items.quantity,
    cast(items.price as decimal(18, 2)) * (1 - cast(items.discount as decimal(18, 2))) as net_price,
    case when parts.size > 25 then 'large' when parts.size > 10 then 'medium' else 'small' end as size_class
from stg_items as items
inner join stg_parts as parts on items.part_id = parts.part_id""",
    "int_order_totals": """
with per_order as (
    select order_id, sum(net_price) as items_total, count(*) as n_items, count(distinct part_id) as n_parts
    from int_items_enriched
    group by order_id
)
select
    orders.order_id,
    orders.customer_id,
    orders.order_date,
    orders.status,
    coalesce(per_order.items_total, 0) as items_total,
    coalesce(per_order.n_items, 0) as n_items,
    case orders.status when 'F' then 'done' when 'O' then 'open' else 'other' end as state
from stg_orders as orders
left join per_order on orders.order_id = per_order.order_id""",
    "int_customer_history": """
select
    *,
    row_number() over (partition by customer_id order by order_date, order_id) as order_number,
    lag(order_date) over (partition by customer_id order by order_date, order_id) as previous_order_date
from int_order_totals""",
    "int_adjustments": """
select 'return_' || cast(order_id as varchar) as adjustment_id, order_id, price as amount, 'return' as kind from stg_items where return_flag = 'R'
union all
select 'discount_' || cast(order_id as varchar), order_id, price * discount, 'discount' from stg_items where discount > 0.05
union all
select 'order_' || cast(order_id as varchar), order_id, total_price, 'order' from stg_orders where status = 'P'""",
    "int_latest_order": """
select order_id, customer_id, order_date
from stg_orders
qualify row_number() over (partition by customer_id order by order_date desc, order_id desc) = 1""",
    "int_event_attribution": """
select
    buys.event_id,
    buys.user_id,
    clicks.event_id as click_id,
    clicks.value as click_value
from stg_events as buys
left join stg_events as clicks
    on buys.user_id = clicks.user_id and clicks.event_type = 'click' and clicks.ts < buys.ts
where buys.event_type = 'purchase'
qualify row_number() over (partition by buys.event_id order by clicks.ts desc nulls last, clicks.event_id desc) = 1""",
    "fct_orders": """
select order_id, customer_id, status, state, items_total, order_number, date_diff('day', previous_order_date, order_date) as days_since_previous
from int_customer_history""",
    "dim_customers": """
with spend as (
    select customer_id, sum(items_total) as lifetime_value, count(*) as n_orders, max(order_number) as last_number
    from fct_orders
    group by customer_id
)
select
    customers.customer_id,
    customers.customer_name || ' (' || customers.segment || ')' as label,
    coalesce(spend.lifetime_value, 0) as lifetime_value,
    coalesce(spend.n_orders, 0) as n_orders,
    spend.n_orders > 10 as is_frequent
from stg_customers as customers
left join spend using (customer_id)""",
    "dim_segments": """
select
    customer_id,
    lifetime_value,
    case when lifetime_value >= 2000000 then 'champion' when lifetime_value >= 500000 then 'regular' else 'occasional' end as segment
from dim_customers""",
    "fct_monthly": """
select
    cast(date_trunc('month', order_date) as date) as month,
    sum(items_total) as revenue,
    sum(items_total) - lag(sum(items_total)) over (order by date_trunc('month', order_date)) as change,
    sum(sum(items_total)) over (order by date_trunc('month', order_date) rows unbounded preceding) as running
from int_order_totals
group by date_trunc('month', order_date)""",
    "fct_part_performance": """
select
    parts.part_id,
    parts.brand,
    cast(count(items.order_id) filter (where items.quantity > 25) as bigint) as big_orders,
    sum(items.net_price) as revenue,
    cast(sum(items.net_price) as double) / nullif(sum(items.quantity), 0) as unit_revenue
from stg_parts as parts
inner join int_items_enriched as items on parts.part_id = items.part_id
group by parts.part_id, parts.brand
having count(*) > 1""",
    "fct_top_parts": """
select part_id, brand, revenue from fct_part_performance order by revenue desc, part_id limit 20""",
    "fct_recent": """
select customer_id, date_diff('day', order_date, (select max(order_date) from stg_orders)) as days_ago
from int_latest_order
where customer_id in (select customer_id from dim_customers where n_orders > 2)""",
    "fct_priorities": """
select customer_id, string_agg(priority, ',' order by priority) as priorities, cast(count(distinct status) as bigint) as n_status
from stg_orders
group by all""",
    "fct_items_slim": """
select * exclude (price, discount) replace (quantity * 2 as quantity) from stg_items""",
}


def reads() -> dict[str, set[str]]:
    return {m: relations(sql) for m, sql in MODELS.items()}


def ancestors(model: str) -> list[str]:
    """The models that a model is made of, in an order that registers each after what it reads."""
    need, todo, of = set(), [model], reads()
    while todo:
        m = todo.pop()
        if m in MODELS and m not in need:
            need.add(m)
            todo += of[m]
    return topological({m: of[m] & need for m in need})


def register(spark: SparkSession, sf_dir: str, models: list[str] | None = None) -> None:
    """Register models (all, by default) and the raw tables that they read as temporary views."""
    of = reads()
    for t in sorted(set().union(*(of[m] for m in models or of)) & set(SOURCES)):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
    for m in models or topological(reads()):
        spark.sql(to_spark(MODELS[m])).createOrReplaceTempView(m)


def model(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    register(spark, sf_dir, ancestors(name))
    return spark.table(name)


def oracle(name: str, select: str = "*") -> str:
    return "WITH " + ", ".join(f"{m} AS ({MODELS[m]})" for m in ancestors(name)) + f" SELECT {select} FROM {name}"
