"""The registered queries as ANSI SQL over the given tables.

Every text starts with the same layers (usage, prices, silver, daily cost, clusters)
and ends in the statement of its query.
"""

from __future__ import annotations

AS_OF = "DATE '2001-07-20'"


def r(x: str, n: int = 2) -> str:
    """Half-up rounding of an exact decimal, as DOUBLE."""
    return f"CAST(ROUND(CAST({x} AS DECIMAL(28,8)), {n}) AS DOUBLE)"


def text(x: str, n: int = 2) -> str:
    """The rounded number with exactly n decimals."""
    return f"CAST(CAST(ROUND(CAST({x} AS DECIMAL(28,8)), {n}) AS DECIMAL(28,{n})) AS VARCHAR)"


def short(x: str) -> str:
    return f"regexp_replace({text(x)}, '0$', '')"


def usd(x: str, n: int = 2) -> str:
    return f"coalesce('$' || format('{{:,.{n}f}}', {r(x, n)}), '$0.00')"


def window(days: int, column: str = "usage_date") -> str:
    return f"{column} BETWEEN {AS_OF} - {days} AND {AS_OF}"


def mean(total: str, n: str) -> str:
    return f"(CAST({total} AS DOUBLE) / nullif({n}, 0))"


BASE = f"""
usage AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS record_id,
         'ws-' || (c_nationkey % 5) AS workspace_id,
         p_type || CASE l_returnflag WHEN 'A' THEN '_PHOTON' WHEN 'R' THEN '_SERVERLESS'
                   ELSE '' END AS sku_name,
         CASE s_nationkey % 3 WHEN 0 THEN 'AWS' WHEN 1 THEN 'AZURE' ELSE 'GCP' END AS cloud,
         l_shipdate AS usage_start_time,
         CAST(l_shipdate AS DATE) AS usage_date,
         strftime(l_shipdate, '%Y-%m') AS usage_month,
         CAST(l_quantity AS DECIMAL(18,4)) AS usage_quantity,
         CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN substr(o_orderpriority, 3) END
           AS environment,
         CASE WHEN p_size % 4 <> 0 THEN p_brand END AS project,
         CASE WHEN c_custkey % 3 <> 0 THEN c_name END AS owner,
         CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS team,
         CASE WHEN c_custkey % 7 <> 0 THEN 'cc-' || c_nationkey END AS cost_center,
         CASE WHEN l_suppkey % 4 = 0
              THEN 'cluster-' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') END AS cluster_id,
         CASE WHEN l_suppkey % 4 = 1
              THEN 'warehouse-' || lpad(CAST(l_suppkey AS VARCHAR), 8, '0') END AS warehouse_id,
         CASE WHEN l_suppkey % 4 = 2 THEN 'job-' || l_suppkey END AS job_id,
         CASE WHEN l_suppkey % 4 = 3 AND l_linenumber % 2 <> 0
              THEN 'pipeline-' || l_suppkey END AS pipeline_id,
         CASE WHEN o_orderstatus <> 'F' THEN c_name END AS run_as,
         CASE WHEN l_linenumber % 3 <> 0 THEN s_name END AS owned_by,
         CASE l_linenumber % 4 WHEN 0 THEN 'SQL' WHEN 1 THEN 'JOBS' WHEN 2 THEN 'ALL_PURPOSE'
              ELSE 'DLT' END AS billing_origin_product
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN part ON l_partkey = p_partkey
  JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_quantity > 0
),
prices AS (
  SELECT p_type || suffix AS sku_name, cloud, price_start_time, price_end_time,
         CAST(base * factor AS DECIMAL(10,4)) AS price
  FROM (SELECT DISTINCT p_type,
               CAST(CASE p_type WHEN 'STANDARD' THEN 0.10 WHEN 'SMALL' THEN 0.15
                    WHEN 'LARGE' THEN 0.40 WHEN 'PROMO' THEN 0.22 WHEN 'ECONOMY' THEN 0.07
                    WHEN 'MEDIUM' THEN 0.30 END AS DECIMAL(6,2)) AS base FROM part) t,
       (VALUES (''), ('_PHOTON'), ('_SERVERLESS')) s(suffix),
       (VALUES ('AWS'), ('AZURE'), ('GCP')) c(cloud),
       (VALUES (TIMESTAMP '1990-01-01', TIMESTAMP '1998-07-01', CAST(1.00 AS DECIMAL(4,2))),
               (TIMESTAMP '1998-07-01', NULL, CAST(1.25 AS DECIMAL(4,2))))
         i(price_start_time, price_end_time, factor)
  WHERE NOT (p_type = 'ECONOMY' AND cloud = 'GCP')
),
silver AS (
  SELECT u.*, p.price AS price_per_unit,
         CASE WHEN p.price IS NOT NULL THEN 'USD' END AS currency_code,
         u.usage_quantity * coalesce(p.price, CAST(0 AS DECIMAL(10,4))) AS estimated_cost_usd,
         coalesce(environment, 'untagged') AS tag_environment,
         coalesce(project, 'untagged') AS tag_project,
         coalesce(owner, 'untagged') AS tag_owner,
         coalesce(team, 'untagged') AS tag_team,
         coalesce(cost_center, 'untagged') AS tag_costcenter,
         coalesce(run_as, owned_by, owner, 'untagged') AS user_email,
         CASE WHEN cluster_id IS NOT NULL THEN 'cluster' WHEN warehouse_id IS NOT NULL
              THEN 'warehouse' WHEN job_id IS NOT NULL THEN 'job'
              WHEN pipeline_id IS NOT NULL THEN 'pipeline' ELSE 'other' END AS resource_type,
         coalesce(cluster_id, warehouse_id, job_id, pipeline_id, 'unknown') AS resource_id
  FROM usage u LEFT JOIN prices p
    ON u.sku_name = p.sku_name AND u.cloud = p.cloud
   AND u.usage_start_time >= p.price_start_time
   AND u.usage_start_time < coalesce(p.price_end_time, CAST({AS_OF} + 1 AS TIMESTAMP))
),
daily_cost AS (
  SELECT usage_date, workspace_id, sku_name, billing_origin_product,
         sum(usage_quantity) AS total_usage, sum(estimated_cost_usd) AS total_cost_usd,
         count(*) AS record_count
  FROM silver GROUP BY ALL
),
cost_by_user AS (
  SELECT usage_date, workspace_id, user_email,
         sum(usage_quantity) AS total_usage, sum(estimated_cost_usd) AS total_cost_usd,
         count(DISTINCT cluster_id) AS distinct_clusters,
         count(DISTINCT warehouse_id) AS distinct_warehouses,
         count(DISTINCT job_id) AS distinct_jobs
  FROM silver GROUP BY usage_date, workspace_id, user_email
),
cost_by_resource AS (
  SELECT usage_date, workspace_id, resource_type, resource_id,
         sum(usage_quantity) AS total_usage, sum(estimated_cost_usd) AS total_cost_usd,
         count(*) AS record_count
  FROM silver GROUP BY usage_date, workspace_id, resource_type, resource_id
),
clusters AS (
  SELECT 'cluster-' || lpad(CAST(s_suppkey AS VARCHAR), 8, '0') AS cluster_id,
         'ws-' || (s_nationkey % 5) AS workspace_id,
         CASE WHEN k % 6 <> 5 THEN 'compute ' || s_suppkey END AS cluster_name,
         s_name AS owned_by,
         CASE s_suppkey % 5 WHEN 0 THEN 'Standard_E64s_v3' WHEN 1 THEN 'Standard_M128s'
              ELSE 'Standard_DS3_v2' END AS worker_node_type,
         CASE WHEN s_suppkey % 3 = 0 THEN 'Standard_NC24s_v3' ELSE 'Standard_DS3_v2' END
           AS driver_node_type,
         CAST(1 + k % 8 AS INTEGER) AS worker_count,
         CAST(CASE WHEN k % 3 = 0 THEN 1 END AS INTEGER) AS min_autoscale_workers,
         CAST(CASE WHEN k % 3 = 0 THEN 5 + k % 8 END AS INTEGER) AS max_autoscale_workers,
         CAST(CASE WHEN version = 1 THEN 30 ELSE CASE k % 5 WHEN 1 THEN 0 WHEN 2 THEN 60
              WHEN 3 THEN 180 WHEN 4 THEN 240 END END AS INTEGER) AS auto_termination_minutes,
         CASE WHEN version = 1 THEN 'JOB' ELSE CASE k % 4 WHEN 0 THEN 'UI' WHEN 1 THEN 'API'
              WHEN 3 THEN 'JOB' END END AS cluster_source,
         CASE WHEN version = 1 THEN DATE '1999-01-01' ELSE DATE '2001-01-01' END AS change_date
  FROM (SELECT *, s_suppkey // 4 AS k FROM supplier WHERE s_suppkey % 4 = 0) s,
       (VALUES (1), (2)) v(version)
  WHERE k % 7 <> 6
),
latest AS (SELECT * FROM clusters WHERE change_date = DATE '2001-01-01')
"""

ORACLE_SQL: dict[str, str] = {}


def oracle(name: str, select: str, ctes: str = "") -> None:
    layers = BASE + (f", {ctes}" if ctes else "")
    ORACLE_SQL[name] = f"WITH {layers} {select}"


# ------------------------------------------------- sources and tables

oracle("bronze_billing_usage", f"""
SELECT record_id, 'account-1' AS account_id, workspace_id, sku_name, cloud,
       strftime(usage_start_time, '%Y-%m-%d %H:%M:%S') AS usage_start_time,
       strftime(usage_start_time + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS usage_end_time,
       usage_date, usage_month, 'DBU' AS usage_unit,
       CAST(usage_quantity AS DOUBLE) AS usage_quantity, 'ORIGINAL' AS record_type,
       usage_date AS ingestion_date, billing_origin_product,
       CAST(NULL AS VARCHAR) AS product_features, 'COMPUTE_TIME' AS usage_type,
       environment, project, owner, team, cost_center, cluster_id, warehouse_id, job_id,
       CAST(NULL AS VARCHAR) AS notebook_id, pipeline_id AS dlt_pipeline_id, run_as, owned_by
FROM usage WHERE {window(90)}""")

oracle("bronze_list_prices", """
SELECT strftime(price_start_time, '%Y-%m-%d %H:%M:%S') AS price_start_time,
       strftime(price_end_time, '%Y-%m-%d %H:%M:%S') AS price_end_time,
       'account-1' AS account_id, sku_name, cloud, 'USD' AS currency_code,
       'DBU' AS usage_unit, CAST(price AS DOUBLE) AS price FROM prices""")

oracle("bronze_clusters", """
SELECT 'account-1' AS account_id, workspace_id, cluster_id, cluster_name, owned_by,
       '1998-01-01 00:00:00' AS create_time, CAST(NULL AS VARCHAR) AS delete_time,
       driver_node_type, worker_node_type, worker_count, min_autoscale_workers,
       max_autoscale_workers, auto_termination_minutes, 'true' AS enable_elastic_disk,
       owned_by AS tags, cluster_source, CAST(NULL AS VARCHAR) AS init_scripts,
       CAST(NULL AS VARCHAR) AS aws_attributes, CAST(NULL AS VARCHAR) AS azure_attributes,
       CAST(NULL AS VARCHAR) AS gcp_attributes,
       CAST(NULL AS VARCHAR) AS driver_instance_pool_id,
       CAST(NULL AS VARCHAR) AS worker_instance_pool_id, '16.4.x' AS dbr_version,
       strftime(change_date, '%Y-%m-%d %H:%M:%S') AS change_time, change_date,
       'SINGLE_USER' AS data_security_mode, CAST(NULL AS VARCHAR) AS policy_id
FROM clusters""")

oracle("bronze_job_runs", f"""
SELECT 'account-1' AS account_id, 'ws-' || (o_custkey % 5) AS workspace_id,
       'job-' || (o_custkey % 100) AS job_id, CAST(o_orderkey AS VARCHAR) AS run_id,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS period_start_time,
       strftime(o_orderdate + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS period_end_time,
       'SCHEDULE' AS trigger_type, 'JOB_RUN' AS run_type, o_orderpriority AS run_name,
       'cluster-' || lpad(CAST(o_custkey % 100 AS VARCHAR), 8, '0') AS compute_ids,
       o_orderstatus AS result_state, CAST(NULL AS VARCHAR) AS termination_code
FROM orders WHERE {window(90, 'CAST(o_orderdate AS DATE)')}""")

oracle("merge_upsert", f"""
SELECT coalesce(f.usage_date, u.usage_date) AS usage_date,
       coalesce(f.workspace_id, u.workspace_id) AS workspace_id,
       coalesce(f.sku_name, u.sku_name) AS sku_name,
       coalesce(f.billing_origin_product, u.billing_origin_product) AS billing_origin_product,
       CAST(CASE WHEN f.n IS NULL THEN u.total_usage ELSE f.total_usage END AS DOUBLE)
         AS total_usage,
       CAST(CASE WHEN u.n IS NULL THEN f.total_cost_usd ELSE u.total_cost_usd END AS DOUBLE)
         AS total_cost_usd,
       CASE WHEN u.n IS NULL THEN f.record_count ELSE u.record_count END AS record_count
FROM first_load f FULL JOIN recent u
  ON f.usage_date = u.usage_date AND f.workspace_id = u.workspace_id
 AND f.sku_name = u.sku_name AND f.billing_origin_product = u.billing_origin_product""",
       f"""
first_load AS (
  SELECT usage_date, workspace_id, sku_name, billing_origin_product,
         sum(usage_quantity) AS total_usage, sum(estimated_cost_usd) AS total_cost_usd,
         count(*) AS record_count, 1 AS n
  FROM silver WHERE usage_quantity < 25
  GROUP BY usage_date, workspace_id, sku_name, billing_origin_product
),
recent AS (SELECT *, 1 AS n FROM daily_cost WHERE {window(30)})""")

oracle("ingest_row_counts", f"""
SELECT 'bronze.billing_usage' AS table_name, count(*) AS row_count FROM usage WHERE {window(90)}
UNION ALL SELECT 'bronze.list_prices', count(*) FROM prices
UNION ALL SELECT 'bronze.clusters', count(*) FROM clusters
UNION ALL SELECT 'silver.usage_enriched', count(*) FROM silver WHERE {window(90)}
UNION ALL SELECT 'gold.daily_cost', count(*) FROM daily_cost WHERE {window(90)}
UNION ALL SELECT 'gold.cost_by_user', count(*) FROM cost_by_user WHERE {window(90)}
UNION ALL SELECT 'gold.cost_by_tags', count(*) FROM (
  SELECT DISTINCT usage_date, workspace_id, tag_environment, tag_project, tag_team,
                  tag_costcenter FROM silver WHERE {window(90)})
UNION ALL SELECT 'gold.cost_by_resource', count(*) FROM cost_by_resource WHERE {window(90)}""")


def profile(name: str, source: str, cost: str = "", days: int | None = 90) -> str:
    dated = days is not None
    return f"""
SELECT '{name}' AS table_name, count(*) AS row_count,
       {'min(usage_date)' if dated else 'CAST(NULL AS DATE)'} AS first_date,
       {'max(usage_date)' if dated else 'CAST(NULL AS DATE)'} AS last_date,
       {'count(DISTINCT usage_date)' if dated else 'CAST(0 AS BIGINT)'} AS dates,
       {r(f'sum({cost})', 4) if cost else 'CAST(NULL AS DOUBLE)'} AS cost_usd
FROM {source} {f"WHERE {window(days)}" if dated else ''}"""


COST_BY_TAGS = """
cost_by_tags AS (
  SELECT usage_date, workspace_id, tag_environment, tag_project, tag_team, tag_costcenter,
         sum(usage_quantity) AS total_usage, sum(estimated_cost_usd) AS total_cost_usd,
         count(*) AS record_count
  FROM silver GROUP BY usage_date, workspace_id, tag_environment, tag_project, tag_team,
                       tag_costcenter
)"""
ROLLUPS = ("daily_cost", "cost_by_user", "cost_by_tags", "cost_by_resource")

oracle("refresh_layers", " UNION ALL ".join([
    profile("bronze.billing_usage", "usage"),
    profile("bronze.list_prices", "prices", days=None),
    profile("bronze.clusters", "clusters", days=None),
    profile("silver.usage_enriched", "silver", "estimated_cost_usd"),
    *(profile(f"gold.{name}", name, "total_cost_usd") for name in ROLLUPS),
    f"""
SELECT 'bronze.job_runs', count(*), NULL, NULL, 0, NULL FROM orders
WHERE {window(90, 'CAST(o_orderdate AS DATE)')}""",
]), COST_BY_TAGS)

oracle("stored_rollups", " UNION ALL ".join(f"""
SELECT usage_date, '{name}' AS rollup, count(*) AS rows,
       CAST(sum(total_usage) AS DOUBLE) AS total_usage,
       CAST(sum(total_cost_usd) AS DOUBLE) AS total_cost_usd
FROM {name} WHERE {window(30)} GROUP BY usage_date""" for name in ROLLUPS), COST_BY_TAGS)

_ROLLUP_KEYS = {
    "daily_cost": ("workspace_id", "sku_name", "billing_origin_product"),
    "cost_by_user": ("workspace_id", "user_email"),
    "cost_by_tags": ("workspace_id", "tag_environment", "tag_project", "tag_team",
                     "tag_costcenter"),
    "cost_by_resource": ("workspace_id", "resource_type", "resource_id"),
}
oracle("late_records", " UNION ALL ".join(f"""
SELECT usage_date, '{name}' AS rollup, concat_ws('|', {', '.join(keys)}) AS keys,
       CAST(total_usage AS DOUBLE) AS total_usage,
       CAST(total_cost_usd AS DOUBLE) AS total_cost_usd
FROM {name} WHERE {window(30)}""" for name, keys in _ROLLUP_KEYS.items()), COST_BY_TAGS)

oracle("merge_into_table", f"""
SELECT coalesce(f.usage_date, u.usage_date) AS usage_date, count(*) AS rows,
       CAST(sum(CASE WHEN f.n IS NULL THEN u.total_usage ELSE f.total_usage END) AS DOUBLE)
         AS total_usage,
       CAST(sum(CASE WHEN u.n IS NULL THEN f.total_cost_usd ELSE u.total_cost_usd END) AS DOUBLE)
         AS total_cost_usd,
       CAST(sum(CASE WHEN u.n IS NULL THEN f.record_count ELSE u.record_count END) AS BIGINT)
         AS record_count,
       CASE WHEN bool_or({window(30, 'coalesce(f.usage_date, u.usage_date)')})
            THEN 'true' ELSE 'false' END AS rewritten
FROM first_load f FULL JOIN recent u
  ON f.usage_date = u.usage_date AND f.workspace_id = u.workspace_id
 AND f.sku_name = u.sku_name AND f.billing_origin_product = u.billing_origin_product
GROUP BY coalesce(f.usage_date, u.usage_date)""",
       f"""
first_load AS (
  SELECT usage_date, workspace_id, sku_name, billing_origin_product,
         sum(usage_quantity) AS total_usage, sum(estimated_cost_usd) AS total_cost_usd,
         count(*) AS record_count, 1 AS n
  FROM silver WHERE usage_quantity < 25 AND {window(90)}
  GROUP BY usage_date, workspace_id, sku_name, billing_origin_product
),
recent AS (SELECT *, 1 AS n FROM daily_cost WHERE {window(30)})""")

# ------------------------------------------------------- silver and gold

for _name in ("price_interval_join", "price_interval_join_shuffled", "price_interval_join_sliced"):
    oracle(_name, """
SELECT record_id, sku_name, cloud, usage_date, CAST(usage_quantity AS DOUBLE) AS usage_quantity,
       CAST(price_per_unit AS DOUBLE) AS price_per_unit, currency_code FROM silver""")

oracle("price_history_join", f"""
SELECT u.record_id, u.sku_name, u.cloud, u.usage_date,
       CAST(u.usage_quantity AS DOUBLE) AS usage_quantity,
       CAST(h.price AS DOUBLE) AS price_per_unit,
       CASE WHEN h.price IS NOT NULL THEN 'USD' END AS currency_code
FROM usage u LEFT JOIN history h
  ON u.sku_name = h.sku_name AND u.cloud = h.cloud AND u.usage_date >= h.day
 AND u.usage_date < coalesce(h.until, {AS_OF} + 1)""", """
changes AS (
  SELECT sku_name, cloud, usage_date AS day,
         lead(usage_date) OVER (PARTITION BY sku_name, cloud ORDER BY usage_date) AS until
  FROM (SELECT DISTINCT sku_name, cloud, usage_date FROM usage)
),
history AS (
  SELECT c.*, CAST(p.price + CAST(dayofyear(day) % 50 AS DECIMAL(4,0)) * CAST(0.0001 AS DECIMAL(5,4))
              AS DECIMAL(10,4)) AS price
  FROM changes c JOIN prices p ON c.sku_name = p.sku_name AND c.cloud = p.cloud
  WHERE p.price_end_time IS NULL
)""")

oracle("usage_without_prices", """
SELECT record_id, CAST(usage_quantity AS DOUBLE) AS usage_quantity,
       0.0::DOUBLE AS estimated_cost_usd FROM usage""")

oracle("cost_computation", """
SELECT record_id, CAST(usage_quantity AS DOUBLE) AS usage_quantity,
       CAST(price_per_unit AS DOUBLE) AS price_per_unit,
       CAST(estimated_cost_usd AS DOUBLE) AS estimated_cost_usd FROM silver""")

oracle("tag_extraction", """
SELECT record_id, tag_environment, tag_project, tag_owner, tag_team, tag_costcenter
FROM silver""")

oracle("usage_enriched", """
SELECT record_id, workspace_id, sku_name, cloud, usage_date, usage_month, 'DBU' AS usage_unit,
       CAST(usage_quantity AS DOUBLE) AS usage_quantity,
       CAST(estimated_cost_usd AS DOUBLE) AS estimated_cost_usd,
       tag_environment, tag_project, tag_owner, tag_team, tag_costcenter,
       cluster_id, warehouse_id, job_id, CAST(NULL AS VARCHAR) AS notebook_id, pipeline_id,
       run_as AS run_as_user, owned_by, billing_origin_product, 'COMPUTE_TIME' AS usage_type,
       'ORIGINAL' AS record_type FROM silver""")

oracle("gold_daily_cost", """
SELECT usage_date, workspace_id, sku_name, billing_origin_product,
       CAST(total_usage AS DOUBLE) AS total_usage,
       CAST(total_cost_usd AS DOUBLE) AS total_cost_usd, record_count FROM daily_cost""")

oracle("gold_cost_by_user", """
SELECT usage_date, workspace_id, user_email, CAST(total_usage AS DOUBLE) AS total_usage,
       CAST(total_cost_usd AS DOUBLE) AS total_cost_usd, distinct_clusters,
       distinct_warehouses, distinct_jobs FROM cost_by_user""")

oracle("gold_cost_by_tags", """
SELECT usage_date, workspace_id, tag_environment, tag_project, tag_team, tag_costcenter,
       CAST(sum(usage_quantity) AS DOUBLE) AS total_usage,
       CAST(sum(estimated_cost_usd) AS DOUBLE) AS total_cost_usd, count(*) AS record_count
FROM silver GROUP BY usage_date, workspace_id, tag_environment, tag_project, tag_team,
                     tag_costcenter""")

oracle("gold_cost_by_resource", """
SELECT usage_date, workspace_id, resource_type, resource_id,
       CAST(total_usage AS DOUBLE) AS total_usage,
       CAST(total_cost_usd AS DOUBLE) AS total_cost_usd, record_count FROM cost_by_resource""")

oracle("daily_totals_latest", f"""
SELECT usage_date, {r('sum(total_cost_usd)', 8)} AS daily_total_usd
FROM daily_cost GROUP BY usage_date ORDER BY usage_date DESC LIMIT 14""")

# ---------------------------------------------------------- cost analysis


def totals(days: int, more: str = "", key: str = "") -> str:
    return f"""
SELECT {r('sum(total_cost_usd)')} AS total_cost_usd,
       {r(mean('sum(total_cost_usd)', str(days)))} AS avg_daily_cost_usd,
       min(usage_date) AS first_date, max(usage_date) AS last_date,
       count(DISTINCT usage_date) AS days_with_data, CAST({days} AS BIGINT) AS days,
       {key or 'CAST(NULL AS VARCHAR) AS workspace_id'}
FROM daily_cost WHERE {window(days)} {more}"""


oracle("total_cost", totals(7))
oracle("total_cost_one_workspace",
       totals(30, "AND workspace_id = 'ws-2'", "'ws-2' AS workspace_id"))
oracle("total_cost_by_workspace", totals(30, "GROUP BY workspace_id", "workspace_id"))

for dimension, column in {
    "sku": "sku_name",
    "product": "billing_origin_product",
    "user": "user_email",
    "team": "tag_team",
    "project": "tag_project",
    "environment": "tag_environment",
    "workspace": "workspace_id",
}.items():
    oracle(f"cost_breakdown_{dimension}", f"""
SELECT {column} AS dimension_value, {r('sum(estimated_cost_usd)')} AS total_cost_usd,
       {r('sum(usage_quantity)')} AS total_usage, count(*) AS record_count,
       '{dimension}' AS dimension
FROM silver WHERE {window(30)} GROUP BY {column} HAVING sum(estimated_cost_usd) > 0
ORDER BY 2 DESC, 1 LIMIT 10""")

TOP_USERS = f"""
SELECT * FROM (
  SELECT user_email, {r('sum(total_cost_usd)')} AS total_cost_usd,
         {r(mean('sum(total_cost_usd)', 'count(*)'))} AS avg_daily_cost_usd,
         CAST(sum(distinct_clusters) AS BIGINT) AS cluster_uses,
         CAST(sum(distinct_warehouses) AS BIGINT) AS warehouse_uses,
         CAST(sum(distinct_jobs) AS BIGINT) AS job_uses
  FROM cost_by_user WHERE {window(30)} GROUP BY user_email)
WHERE total_cost_usd > 0 ORDER BY total_cost_usd DESC, user_email LIMIT 10"""
oracle("top_spenders_user", TOP_USERS)

oracle("top_spenders_resource", f"""
SELECT * FROM (
  SELECT resource_type, resource_id, {r('sum(total_cost_usd)')} AS total_cost_usd,
         {r(mean('sum(total_cost_usd)', 'count(*)'))} AS avg_daily_cost_usd,
         count(DISTINCT usage_date) AS active_days
  FROM cost_by_resource WHERE {window(30)} AND resource_id <> 'unknown'
  GROUP BY resource_type, resource_id)
WHERE total_cost_usd > 0
ORDER BY total_cost_usd DESC, resource_type, resource_id LIMIT 10""")


def trend(period: str) -> str:
    return f"""
SELECT period, total_cost_usd, record_count,
       CASE WHEN prior > 0 THEN {r('(total_cost_usd - prior) / prior * 100', 1)} END
         AS pct_change_vs_prior
FROM (SELECT *, lag(total_cost_usd) OVER (ORDER BY period) AS prior FROM (
        SELECT {period} AS period, {r('sum(total_cost_usd)')} AS total_cost_usd,
               CAST(sum(record_count) AS BIGINT) AS record_count
        FROM daily_cost WHERE {window(90)} GROUP BY 1))"""


oracle("cost_trend_day", trend("usage_date"))
oracle("cost_trend_week", trend("CAST(date_trunc('week', usage_date) AS DATE)"))
oracle("cost_trend_month", trend("CAST(date_trunc('month', usage_date) AS DATE)"))

# --------------------------------------------------------------- anomalies


def spikes(dimension: str, value: str, floor: float) -> str:
    over = ("(PARTITION BY dim_value ORDER BY usage_date "
            "ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)")
    return f"""
SELECT usage_date, dim_value, {r('cost')} AS daily_cost_usd,
       {r('baseline')} AS baseline_avg_usd, baseline_days,
       {r('pct', 1)} AS pct_above_baseline, {r('over_usd')} AS delta_usd,
       '{dimension}' AS dimension, 'COST_SPIKE' AS finding_type,
       CASE WHEN {r('over_usd')} >= 5000 THEN 'CRITICAL' WHEN {r('over_usd')} >= 500 THEN 'HIGH'
            WHEN {r('over_usd')} >= 50 THEN 'MEDIUM' ELSE 'LOW' END AS severity
FROM (SELECT *, cost - baseline AS over_usd,
             (cost - baseline) / nullif(baseline, 0) * 100 AS pct
      FROM (SELECT usage_date, dim_value, CAST(cost AS DOUBLE) AS cost,
                   count(cost) OVER {over} AS baseline_days,
                   CAST(sum(cost) OVER {over} AS DOUBLE) / nullif(count(cost) OVER {over}, 0)
                     AS baseline
            FROM (SELECT usage_date, {value} AS dim_value, sum(estimated_cost_usd) AS cost
                  FROM silver WHERE {window(90)} GROUP BY 1, 2)))
WHERE cost >= {floor} AND baseline_days >= 3 AND baseline > 0 AND pct >= 30"""


SPIKES_WORKSPACE = spikes("workspace", "workspace_id", 5)
oracle("cost_spikes_workspace", SPIKES_WORKSPACE)
oracle("cost_spikes_sku", spikes("sku", "sku_name", 5))
oracle("cost_spikes_resource",
       spikes("resource", "coalesce(cluster_id, warehouse_id, job_id, 'unknown')", 1))

oracle("sustained_spikes", """
SELECT dimension, dim_value, first_date, last_date, spike_days, total_delta_usd,
       max_pct_above_baseline,
       CASE WHEN total_delta_usd >= 5000 THEN 'CRITICAL' WHEN total_delta_usd >= 500 THEN 'HIGH'
            ELSE 'MEDIUM' END AS severity, 'SUSTAINED_COST_SPIKE' AS finding_type
FROM (SELECT dimension, dim_value, min(usage_date) AS first_date, max(usage_date) AS last_date,
             count(*) AS spike_days,
             CAST(ROUND(sum(CAST(delta_usd AS DECIMAL(28,8))), 2) AS DOUBLE) AS total_delta_usd,
             max(pct_above_baseline) AS max_pct_above_baseline
      FROM (SELECT *, usage_date - CAST(row_number() OVER (
                      PARTITION BY dim_value ORDER BY usage_date) AS INTEGER) AS island
            FROM spiked)
      GROUP BY dimension, dim_value, island)
WHERE spike_days >= 2""", f"spiked AS ({SPIKES_WORKSPACE})")


def resource_costs(column: str, days: int, more: str = "") -> str:
    return f"""
SELECT {column}, workspace_id, count(DISTINCT usage_date) AS active_days,
       sum(estimated_cost_usd) AS cost, sum(usage_quantity) AS dbu {more}
FROM silver WHERE {column} IS NOT NULL AND {window(days)} GROUP BY {column}, workspace_id"""


IDLE_CLUSTERS = f"""
SELECT c.cluster_id, cluster_name, c.workspace_id, owned_by, worker_node_type,
       driver_node_type, worker_count, auto_termination_minutes, cluster_source, active_days,
       {r('cost')} AS total_cost_usd, {r('dbu')} AS total_dbu,
       'IDLE_CLUSTER_RISK' AS finding_type,
       CASE WHEN coalesce(auto_termination_minutes, 0) = 0 THEN 'Auto-termination disabled'
            ELSE 'Auto-termination too long (' || auto_termination_minutes || ' min)' END
         AS reason,
       CASE WHEN {r('cost')} > 100 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM ({resource_costs('cluster_id', 90)}) c LEFT JOIN latest m ON c.cluster_id = m.cluster_id
WHERE cost > 1
  AND (auto_termination_minutes IS NULL OR auto_termination_minutes = 0
       OR auto_termination_minutes > 120)
  AND coalesce(cluster_source, 'UI') IN ('UI', 'API')"""
oracle("idle_clusters", IDLE_CLUSTERS)

oracle("idle_clusters_no_metadata", f"""
SELECT cluster_id, CAST(NULL AS VARCHAR) AS cluster_name, workspace_id,
       CAST(NULL AS VARCHAR) AS owned_by, active_days, {r('cost')} AS total_cost_usd,
       {r('dbu')} AS total_dbu, 'IDLE_CLUSTER_RISK' AS finding_type,
       'Auto-termination disabled' AS reason,
       CASE WHEN {r('cost')} > 100 THEN 'HIGH' ELSE 'MEDIUM' END AS severity
FROM ({resource_costs('cluster_id', 30)}) WHERE {r('cost')} > 5""")

oracle("idle_warehouses", f"""
SELECT warehouse_id, workspace_id, active_days, {r('cost')} AS total_cost_usd,
       {r('dbu')} AS total_dbu, 'WAREHOUSE_UNDERUSED_RISK' AS finding_type,
       'MEDIUM' AS severity,
       'High cost — verify query volume justifies size & uptime' AS reason
FROM ({resource_costs('warehouse_id', 30)}) WHERE {r('cost')} > 5""")

# ------------------------------------------------------------- run metrics

RUN_CTES = f"""
dates AS (
  SELECT usage_date, sum(total_cost_usd) AS cost,
         row_number() OVER (ORDER BY usage_date DESC) AS age
  FROM daily_cost WHERE {window(90)} GROUP BY usage_date
),
skus AS (
  SELECT sku_name, sum(total_cost_usd) AS cost FROM daily_cost
  WHERE {window(90)} GROUP BY sku_name ORDER BY cost DESC, sku_name LIMIT 1
),
sums AS (
  SELECT CAST(sum(cost) AS DOUBLE) AS total, count(*) AS n,
         CAST(sum(cost) FILTER (age <= 7) AS DOUBLE) AS last_7,
         CASE WHEN count(*) >= 14
              THEN CAST(sum(cost) FILTER (age BETWEEN 8 AND 14) AS DOUBLE)
              ELSE 0 END AS prior_7
  FROM dates
),
metrics AS (
  SELECT {r('total')} AS total_cost_usd, {r('total / n')} AS avg_daily_cost_usd,
         {r('last_7')} AS last_7d_cost_usd, {r('prior_7')} AS prior_7d_cost_usd,
         {r('CASE WHEN prior_7 > 0 THEN (last_7 - prior_7) / prior_7 * 100 ELSE 0 END')}
           AS wow_change_pct,
         {r('CASE WHEN total > 0 THEN CAST(skus.cost AS DOUBLE) / total * 100 ELSE 0 END')}
           AS top_sku_share_pct,
         n AS lookback_days, sku_name AS top_sku, {r('skus.cost', 8)} AS top_sku_cost
  FROM sums, skus
),
stats AS (
  SELECT count(*) AS n, CAST(sum(cost) AS DOUBLE) / count(*) AS mean,
         CASE WHEN stddev_samp(CAST(cost AS DOUBLE)) > 0
              THEN stddev_samp(CAST(cost AS DOUBLE)) ELSE 1e-9 END AS std
  FROM dates
),
scored AS (
  SELECT usage_date, CAST(cost AS DOUBLE) AS cost, mean, std,
         (CAST(cost AS DOUBLE) - mean) / std AS z
  FROM dates, stats WHERE n >= 7
),
zscores AS (
  SELECT 'anomaly' AS category, CASE WHEN abs(z) >= 3 THEN 'high' ELSE 'medium' END AS severity,
         'Daily cost ' || CASE WHEN z > 0 THEN 'spike' ELSE 'drop' END || ' on ' || usage_date
           AS title,
         'Daily cost was $' || {text('cost')} || ', ' || {text('abs(z)', 1)} ||
           ' std devs from the 90-day mean of $' || {text('mean')} || '.' AS description,
         'workspace_total' AS affected_resource, {r('cost', 4)} AS metric_value,
         {r('mean', 4)} AS baseline_value, {r('z', 4)} AS zscore, {r('mean', 4)} AS mean,
         {r('std', 4)} AS std, CAST(NULL AS DOUBLE) AS share_pct,
         CAST(NULL AS DOUBLE) AS wow_change_pct
  FROM scored WHERE abs(z) >= 2.0 AND cost >= 5
),
concentration AS (
  SELECT 'concentration' AS category, 'medium' AS severity,
         'High concentration in SKU ' || top_sku AS title,
         {text('top_sku_share_pct', 1)} || '% of total spend comes from a single SKU. '
           || 'Diversification or commitment discounts may be appropriate.' AS description,
         top_sku AS affected_resource, {r('top_sku_cost', 4)} AS metric_value,
         total_cost_usd AS baseline_value, CAST(NULL AS DOUBLE) AS zscore,
         CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std,
         top_sku_share_pct AS share_pct, CAST(NULL AS DOUBLE) AS wow_change_pct
  FROM metrics WHERE top_sku_share_pct > 10
),
wow AS (
  SELECT 'trend' AS category,
         CASE WHEN wow_change_pct >= 50 THEN 'high' ELSE 'medium' END AS severity,
         'Spend up ' || {text('wow_change_pct', 1)} || '% week-over-week' AS title,
         'Last 7 days: $' || {text('last_7d_cost_usd')} || ' vs prior 7 days: $'
           || {text('prior_7d_cost_usd')} || '.' AS description,
         'workspace_total' AS affected_resource, last_7d_cost_usd AS metric_value,
         prior_7d_cost_usd AS baseline_value, CAST(NULL AS DOUBLE) AS zscore,
         CAST(NULL AS DOUBLE) AS mean, CAST(NULL AS DOUBLE) AS std,
         CAST(NULL AS DOUBLE) AS share_pct, wow_change_pct
  FROM metrics WHERE wow_change_pct >= 10
)"""


def finding(source: str, severity: str = "severity") -> str:
    return f"""
SELECT sha256(category || '|' || affected_resource || '|' || title) AS finding_id, category,
       {severity} AS severity, title, description, affected_resource, metric_value,
       baseline_value, '2001-07-20 00:00:00' AS detected_at, zscore, mean, std, share_pct,
       wow_change_pct FROM {source}"""


EVERY_FINDING = ("(SELECT * FROM zscores UNION ALL SELECT * FROM concentration "
                 "UNION ALL SELECT * FROM wow)")
oracle("daily_zscore_anomalies", finding("zscores"), RUN_CTES)
oracle("sku_concentration", finding("concentration"), RUN_CTES)
oracle("wow_jump", finding("wow"), RUN_CTES)
oracle("all_findings", finding(EVERY_FINDING, "upper(severity)"), RUN_CTES)

oracle("top_skus", f"""
SELECT sku_name, {r('sum(total_cost_usd)', 8)} AS cost_usd FROM daily_cost
WHERE {window(90)} GROUP BY sku_name ORDER BY cost_usd DESC, sku_name LIMIT 10""")

oracle("summary_metrics", """
SELECT total_cost_usd, avg_daily_cost_usd, last_7d_cost_usd, prior_7d_cost_usd,
       wow_change_pct, top_sku_share_pct, lookback_days FROM metrics""", RUN_CTES)

oracle("persist_findings", f"""
SELECT finding_id, 'run-1' AS run_id, detected_at, category AS finding_type, severity,
       affected_resource AS resource_id, metric_value, baseline_value,
       {r('(raw_metric - raw_baseline) / nullif(raw_baseline, 0) * 100', 4)} AS delta_pct,
       title AS headline, description AS explanation, zscore, 'OPEN' AS status
FROM (SELECT f.*,
             CASE category WHEN 'anomaly' THEN s.cost WHEN 'concentration' THEN m.top_sku_cost
                  ELSE m.last_7d_cost_usd END AS raw_metric,
             CASE category WHEN 'anomaly' THEN s.mean WHEN 'concentration'
                  THEN m.total_cost_usd ELSE m.prior_7d_cost_usd END AS raw_baseline
      FROM ({finding(EVERY_FINDING, 'upper(severity)')}) f, metrics m
      LEFT JOIN scored s ON f.category = 'anomaly'
                        AND f.title LIKE '%' || CAST(s.usage_date AS VARCHAR))""", RUN_CTES)

# ---------------------------------------------------------- recommendations


def savings(days: int, factor: float) -> str:
    return r(f"total_cost_usd / {days}.0::DOUBLE * 30.0::DOUBLE * {factor}::DOUBLE")


CLUSTER_STATS = """,
       CAST(sum(estimated_cost_usd) AS DOUBLE) / count(estimated_cost_usd) AS mean_cost,
       stddev_samp(CAST(estimated_cost_usd AS DOUBLE)) AS spread"""


def rightsizing(metadata: bool) -> str:
    joined = "LEFT JOIN latest m ON c.cluster_id = m.cluster_id" if metadata else ""
    columns = (
        "cluster_name, owned_by, worker_node_type, driver_node_type, worker_count" if metadata
        else "CAST(NULL AS VARCHAR) AS cluster_name, CAST(NULL AS VARCHAR) AS owned_by, "
             "CAST(NULL AS VARCHAR) AS worker_node_type, "
             "CAST(NULL AS VARCHAR) AS driver_node_type, CAST(NULL AS INTEGER) AS worker_count"
    )
    return f"""
SELECT *, 'RIGHT_SIZE' AS recommendation_type, {savings(30, 0.3)} AS expected_savings_usd_monthly,
       'MEDIUM' AS confidence,
       'Right-size cluster ' || coalesce(cluster_name, substr(cluster_id, 1, 12)) AS title,
       'Cluster cost $' || {short('total_cost_usd')} || ' over 30 days. '
         || 'Variance suggests over-provisioning during low-load periods.' AS rationale
FROM (SELECT c.cluster_id, c.workspace_id, {columns}, active_days,
             {r('cost')} AS total_cost_usd, {r('dbu')} AS total_dbu,
             {r('mean_cost')} AS avg_daily_cost,
             {r('coalesce(spread, 0)')} AS stddev_daily_cost,
             {r('CAST(cost AS DOUBLE) / greatest(active_days, 1)')} AS cost_per_active_day
      FROM ({resource_costs('cluster_id', 30, CLUSTER_STATS)}) c {joined}
      WHERE cost >= 10)"""


AUTOSCALE = f"""
SELECT *, 'ENABLE_AUTOSCALE' AS recommendation_type,
       {savings(90, 0.2)} AS expected_savings_usd_monthly, 'MEDIUM' AS confidence,
       'Enable autoscale on ' || coalesce(cluster_name, substr(cluster_id, 1, 12)) AS title,
       'Fixed-size cluster (' || worker_count || ' workers) shows high cost variance (CV='
         || {short('coefficient_of_variation')}
         || '). Autoscale would reduce idle worker time.' AS rationale
FROM (SELECT c.cluster_id, cluster_name, c.workspace_id, owned_by, worker_count,
             min_autoscale_workers, max_autoscale_workers,
             {r('spread / mean_cost')} AS coefficient_of_variation,
             {r('cost')} AS total_cost_usd, active_days
      FROM ({resource_costs('cluster_id', 90, CLUSTER_STATS)}) c
      JOIN latest m ON c.cluster_id = m.cluster_id
      WHERE active_days >= 3 AND min_autoscale_workers IS NULL AND worker_count >= 2
        AND mean_cost <> 0 AND spread / mean_cost > 0.4 AND cost > 20)"""

PHOTON = f"""
SELECT *, 'ENABLE_PHOTON' AS recommendation_type,
       {savings(30, 0.4)} AS expected_savings_usd_monthly, 'MEDIUM' AS confidence,
       'Enable Photon on warehouse ' || substr(warehouse_id, 1, 12) AS title,
       'Warehouse spent $' || {short('total_cost_usd')} || ' on non-Photon SQL over 30 days. '
         || 'Photon typically delivers 2-3x throughput, reducing $/query.' AS rationale
FROM (SELECT warehouse_id, workspace_id, sku_name,
             {r('sum(estimated_cost_usd)')} AS total_cost_usd,
             {r('sum(usage_quantity)')} AS total_dbu,
             count(DISTINCT usage_date) AS active_days
      FROM silver WHERE warehouse_id IS NOT NULL AND {window(30)}
       AND lower(sku_name) NOT LIKE '%photon%'
       AND lower(billing_origin_product) IN ('sql', 'jobs', 'all_purpose')
      GROUP BY warehouse_id, workspace_id, sku_name)
WHERE total_dbu >= 5"""

# The wording and names below equal the operators'.
SERVERLESS = f"""
SELECT *, 'MIGRATE_SERVERLESS' AS recommendation_type,
       {savings(90, 0.25)} AS expected_savings_usd_monthly, 'LOW' AS confidence,
       'Migrate job ' || job_id || ' to serverless' AS title,
       'Short, recurring job (avg $' || {short('avg_per_run_cost')}
         || '/run). Serverless eliminates cluster startup overhead.' AS rationale
FROM (SELECT job_id, workspace_id, count(DISTINCT usage_date) AS active_days,
             {r('sum(estimated_cost_usd)')} AS total_cost_usd,
             {r('CAST(sum(estimated_cost_usd) AS DOUBLE) / count(*)')} AS avg_per_run_cost,
             {r('sum(usage_quantity)')} AS total_dbu
      FROM silver WHERE job_id IS NOT NULL AND {window(90)}
       AND lower(sku_name) NOT LIKE '%serverless%'
      GROUP BY job_id, workspace_id)
WHERE total_cost_usd > 10 AND avg_per_run_cost < 5
ORDER BY total_cost_usd DESC, job_id, workspace_id"""

oracle("rec_rightsizing", rightsizing(True))
oracle("rec_rightsizing_no_metadata", rightsizing(False))
oracle("rec_autoscale", AUTOSCALE)
oracle("rec_photon", PHOTON)
oracle("rec_serverless", SERVERLESS)


def common(source: str, kind: str, id_column: str, name: str, more: str = "") -> str:
    return f"""
SELECT sha256(concat_ws('|', recommendation_type, {id_column}, workspace_id{more}))
         AS recommendation_id, recommendation_type, '{kind}' AS resource_type,
       {id_column} AS resource_id, {name} AS resource_name, workspace_id, title, rationale,
       expected_savings_usd_monthly, confidence FROM ({source})"""


EVERY_RECOMMENDATION = "recommended AS (" + " UNION ALL ".join([
    common(rightsizing(True), "cluster", "cluster_id", "cluster_name"),
    common(AUTOSCALE, "cluster", "cluster_id", "cluster_name"),
    common(PHOTON, "warehouse", "warehouse_id", "CAST(NULL AS VARCHAR)", ", sku_name"),
    common(SERVERLESS, "job", "job_id", "CAST(NULL AS VARCHAR)"),
]) + ")"
oracle("all_recommendations", "SELECT * FROM recommended", EVERY_RECOMMENDATION)

oracle("stored_runs", f"""
SELECT 'findings' AS audit_table, run_id, finding_id AS id, category AS type, 'OPEN' AS status,
       {AS_OF} AS day
FROM ({finding(EVERY_FINDING, 'upper(severity)')}) f, (VALUES ('run-1'), ('run-2')) r(run_id)
UNION ALL
SELECT 'recommendations', run_id, recommendation_id, recommendation_type, 'PROPOSED', {AS_OF}
FROM recommended, (VALUES ('run-1'), ('run-2')) r(run_id)""",
       f"{RUN_CTES}, {EVERY_RECOMMENDATION}")


def stored_text(**columns: str) -> str:
    return "concat_ws('|', " + ", ".join(f"'{n}=' || {v}" for n, v in columns.items()) + ")"


_AT = "'2001-07-20 06:01:30'"
_USERS = "(SELECT DISTINCT user_id AS u FROM events WHERE user_id % 10 <> 9)"
oracle("audit_defaults", f"""
SELECT 'llm_calls' AS audit_table, {stored_text(
    call_id="event_id", run_id="'run-' || user_id",
    called_at="strftime(ts, '%Y-%m-%d %H:%M:%S')", endpoint="event_type")} AS stored
FROM events
UNION ALL
SELECT 'runs', {stored_text(
    run_id="'run-' || user_id", started_at="strftime(min(ts), '%Y-%m-%d %H:%M:%S')",
    findings_count="0", recommendations_count="0", llm_calls="0", llm_tokens="0")}
FROM events GROUP BY user_id
UNION ALL
SELECT 'findings', {stored_text(
    finding_id="'finding-' || u", run_id="'run-1'", detected_at=_AT,
    finding_type="'anomaly'", severity="'LOW'", status="'OPEN'")} FROM {_USERS}
UNION ALL
SELECT 'recommendations', {stored_text(
    recommendation_id="'do-finding-' || u", run_id="'run-1'", created_at=_AT,
    recommendation_type="'RIGHT_SIZE'", title="'resize'", status="'PROPOSED'")} FROM {_USERS}
UNION ALL
SELECT 'actions', {stored_text(
    action_id="'act-finding-' || u", run_id="'run-1'", finding_id="'finding-' || u",
    proposed_at=_AT, action_type="'notify'")} FROM {_USERS}""")

S = "greatest(coalesce(expected_savings_usd_monthly, 0), 0)"
TIER = f"""CASE WHEN {S} > 1000 THEN 'P0' WHEN {S} >= 500 THEN 'P1' WHEN {S} >= 100 THEN 'P2'
       ELSE 'P3' END"""
SCORE = r(f"""CASE
       WHEN {S} > 1000 THEN 80.0::DOUBLE + (least({S}, 10000) - 1000) / 9000.0::DOUBLE * 20
       WHEN {S} >= 500 THEN 60.0::DOUBLE + ({S} - 500) / 500.0::DOUBLE * 19
       WHEN {S} >= 100 THEN 40.0::DOUBLE + ({S} - 100) / 400.0::DOUBLE * 19
       ELSE {S} / 100.0::DOUBLE * 39 END""")
oracle("prioritize_recommendations", f"""
SELECT recommendation_id, expected_savings_usd_monthly, {SCORE} AS priority_score,
       {TIER} AS priority_tier FROM recommended""", EVERY_RECOMMENDATION)

oracle("persist_recommendations", f"""
SELECT recommendation_id, 'run-1' AS run_id, '2001-07-20 06:01:30' AS created_at,
       recommendation_type, resource_type, resource_id, resource_name, workspace_id, title,
       rationale, expected_savings_usd_monthly, confidence, {SCORE} AS priority_score,
       {TIER} AS priority_tier, CAST(NULL AS VARCHAR) AS implementation_steps,
       CAST(NULL AS VARCHAR) AS risks, 'PROPOSED' AS status,
       CAST(NULL AS VARCHAR) AS accepted_by, CAST(NULL AS VARCHAR) AS implemented_at,
       CAST(NULL AS DOUBLE) AS actual_savings_usd FROM recommended""", EVERY_RECOMMENDATION)

# ------------------------------------------------------ forecast and policy

MONTH_TO_DATE = f"usage_date BETWEEN DATE '2001-07-01' AND {AS_OF}"


def projection(key: str, group: str = "", where: str = MONTH_TO_DATE) -> str:
    return f"""
SELECT {key} AS workspace_id, mtd AS mtd_total_usd, {r('avg_daily')} AS avg_daily_cost_usd,
       CAST(20 AS BIGINT) AS days_elapsed, CAST(11 AS BIGINT) AS days_remaining,
       CAST(31 AS BIGINT) AS days_in_month,
       {r('mtd + avg_daily * 11')} AS projected_month_end_usd,
       'linear_avg_daily' AS projection_method
FROM (SELECT *, coalesce(mtd / nullif(n, 0), 0) AS avg_daily FROM (
        SELECT {group + ',' if group else ''}
               coalesce({r('sum(total_cost_usd)')}, 0) AS mtd,
               count(DISTINCT usage_date) AS n
        FROM daily_cost WHERE {where} {'GROUP BY ' + group if group else ''}))"""


oracle("month_end_projection", projection("CAST(NULL AS VARCHAR)"))
oracle("month_end_projection_by_workspace", projection("workspace_id", "workspace_id"))


def dollars(x: str) -> str:
    return f"format('{{:,.0f}}', {r(x, 0)})"


oracle("burn_rate", f"""
SELECT workspace_id, monthly_budget_usd, mtd_total_usd AS mtd_spend_usd,
       projected_month_end_usd, {r('consumed', 1)} AS pct_budget_consumed,
       {r('elapsed', 1)} AS pct_month_elapsed, {r('overrun', 1)} AS pct_projected_overrun,
       CASE WHEN overrun >= 10 THEN 'CRITICAL' WHEN consumed >= 80 AND elapsed < 80 THEN 'HIGH'
            WHEN consumed >= 80 THEN 'MEDIUM' ELSE 'OK' END AS alert_level,
       CASE WHEN overrun >= 10
            THEN 'Projected overrun: $' || {dollars('projected_month_end_usd - monthly_budget_usd')}
                 || ' above $' || {dollars('monthly_budget_usd')} || ' budget'
            WHEN consumed >= 80 AND elapsed < 80
            THEN 'Burning fast: ' || {text('consumed', 0)} || '% of budget used at '
                 || {text('elapsed', 0)} || '% of month'
            WHEN consumed >= 80
            THEN 'Approaching budget cap (' || {text('consumed', 0)} || '% used)'
            ELSE 'On track (' || {text('consumed', 0)} || '% of budget at '
                 || {text('elapsed', 0)} || '% of month)' END AS message
FROM (SELECT b.workspace_id, b.monthly_budget_usd,
             coalesce(p.mtd_total_usd, 0) AS mtd_total_usd,
             coalesce(p.projected_month_end_usd, 0) AS projected_month_end_usd,
             CASE WHEN monthly_budget_usd > 0
                  THEN coalesce(p.mtd_total_usd, 0) / monthly_budget_usd * 100 ELSE 0 END
               AS consumed,
             CAST(20 AS DOUBLE) / 31 * 100 AS elapsed,
             CASE WHEN monthly_budget_usd > 0
                  THEN (coalesce(p.projected_month_end_usd, 0) - monthly_budget_usd)
                       / monthly_budget_usd * 100 ELSE 0 END AS overrun
      FROM budgets b LEFT JOIN projected p
        ON b.workspace_id IS NOT DISTINCT FROM p.workspace_id)""", f"""
budgets AS (
  SELECT 'ws-' || n AS workspace_id,
         CAST(customers * CASE n WHEN 0 THEN 1.00 WHEN 1 THEN 2.00 WHEN 2 THEN 3.00
              WHEN 3 THEN 4.00 ELSE 0.00 END AS DOUBLE) AS monthly_budget_usd
  FROM (SELECT c_nationkey % 5 AS n, count(*) AS customers FROM customer GROUP BY 1)
  UNION ALL SELECT NULL, CAST(count(*) * 3.00 AS DOUBLE) FROM customer
),
projected AS ({projection('workspace_id', 'workspace_id')}
  UNION ALL {projection('CAST(NULL AS VARCHAR)')})""")

UNTAGGED = f"""
SELECT *, CASE WHEN total_cost_usd > 100 THEN 'HIGH' WHEN total_cost_usd > 20 THEN 'MEDIUM'
               ELSE 'LOW' END AS severity,
       resource_type || ' missing tags: ' || replace(missing_tags, ',', ', ') AS headline
FROM (SELECT workspace_id, resource_id, resource_type, tag_environment, tag_project, tag_team,
             tag_costcenter, {r('sum(estimated_cost_usd)')} AS total_cost_usd,
             concat_ws(',', CASE WHEN tag_environment = 'untagged' THEN 'Environment' END,
                       CASE WHEN tag_project = 'untagged' THEN 'Project' END,
                       CASE WHEN tag_team = 'untagged' THEN 'Team' END) AS missing_tags,
             CAST((CASE WHEN tag_environment = 'untagged' THEN 1 ELSE 0 END)
               + (CASE WHEN tag_project = 'untagged' THEN 1 ELSE 0 END)
               + (CASE WHEN tag_team = 'untagged' THEN 1 ELSE 0 END) AS BIGINT)
               AS missing_count, 'UNTAGGED_RESOURCE' AS finding_type
      FROM silver WHERE {window(30)}
      GROUP BY workspace_id, resource_id, resource_type, tag_environment, tag_project,
               tag_team, tag_costcenter
      HAVING sum(estimated_cost_usd) >= 1
         AND 'untagged' IN (tag_environment, tag_project, tag_team))
ORDER BY total_cost_usd DESC, workspace_id, resource_type, resource_id, tag_environment,
         tag_project, tag_team, tag_costcenter"""
oracle("untagged_resources", UNTAGGED)

# The wording and names below equal the operators'.
NODES = ("('Standard_E64s_v3', 'Standard_E64s_v5', 'Standard_M128s', 'Standard_NC24s_v3', "
         "'Standard_ND40rs_v2')")
oracle("expensive_node_types", f"""
SELECT c.cluster_id, cluster_name, c.workspace_id, owned_by, worker_node_type,
       driver_node_type, worker_count, {r('cost')} AS total_cost_usd,
       'EXPENSIVE_NODE_TYPE' AS finding_type, 'MEDIUM' AS severity,
       'Cluster ' || coalesce(cluster_name, substr(c.cluster_id, 1, 12))
         || ' uses expensive node type ' || worker_node_type AS headline,
       'Verify workload requires this size; consider downgrading to a smaller VM.'
         AS recommended_action
FROM ({resource_costs('cluster_id', 30)}) c JOIN latest m ON c.cluster_id = m.cluster_id
WHERE worker_node_type IN {NODES} OR driver_node_type IN {NODES}""")


def tagged(column: str) -> str:
    return r(f"sum(CASE WHEN {column} <> 'untagged' THEN estimated_cost_usd ELSE 0 END)")


oracle("tag_compliance", f"""
SELECT {r('(env / total * 100 + proj / total * 100 + team / total * 100 + own / total * 100) / 4',
          1)} AS compliance_score,
       {r('env / total * 100', 1)} AS pct_cost_with_environment_tag,
       {r('proj / total * 100', 1)} AS pct_cost_with_project_tag,
       {r('team / total * 100', 1)} AS pct_cost_with_team_tag,
       {r('own / total * 100', 1)} AS pct_cost_with_owner_tag,
       {r('total - env')} AS untagged_cost_usd, total AS total_cost_usd,
       CAST(NULL AS VARCHAR) AS message
FROM (SELECT {r('sum(estimated_cost_usd)')} AS total, {tagged('tag_environment')} AS env,
             {tagged('tag_project')} AS proj, {tagged('tag_team')} AS team,
             {tagged('tag_owner')} AS own
      FROM silver WHERE {window(30)})""")

# ----------------------------------------------------------------- reports


def table_lines(section: int, source: str, heading: str, columns: list[str], row: str) -> str:
    head = "| " + " | ".join(columns) + " |"
    rule = "| " + " | ".join(["---"] * len(columns)) + " |"
    first = f"[E'\\n### {heading}', '{head}', '{rule}', {row}]"
    return f"""
SELECT 'cost_summary' AS report, {section} AS section,
       CAST(rank * 10 + pos - 1 AS INTEGER) AS seq, lines[pos] AS line
FROM (SELECT rank, lines, unnest(generate_series(1, len(lines))) AS pos
      FROM (SELECT rank, CASE WHEN rank = 1 THEN {first} ELSE [{row}] END AS lines
            FROM ({source})))"""


# The wording and names below equal the operators'.
COST_LINES = f"""
SELECT 'cost_summary' AS report, 0 AS section, seq, line FROM (
  SELECT unnest([0, 1, 2, 3]) AS seq,
         unnest([E'## 💰 Cost Summary (last 30 days)\\n',
                 '**Total spend:** ' || {usd('total_cost_usd')} || '  ',
                 '**Avg daily:** ' || {usd('avg_daily_cost_usd')} || '  ',
                 '**Window:** ' || first_date || ' → ' || last_date || E'\\n']) AS line
  FROM ({totals(30)}))
UNION ALL {table_lines(1, f'''
  SELECT *, row_number() OVER (ORDER BY cost DESC, product) AS rank FROM (
    SELECT billing_origin_product AS product, {r('sum(estimated_cost_usd)')} AS cost,
           count(*) AS records
    FROM silver WHERE {window(30)} GROUP BY 1 HAVING sum(estimated_cost_usd) > 0)''',
    'By Product', ['Product', 'Cost (USD)', 'Records'],
    f"'| ' || product || ' | ' || {usd('cost')} || ' | ' || format('{{:,}}', records) || ' |'")}
UNION ALL {table_lines(2, f'''
  SELECT *, row_number() OVER (ORDER BY total_cost_usd DESC, user_email) AS rank
  FROM ({TOP_USERS}) QUALIFY rank <= 5''',
    'Top 5 Users', ['User', 'Cost (USD)', 'Avg/day'],
    f"'| ' || CASE WHEN length(user_email) > 40 THEN substr(user_email, 1, 37) || '...' "
    f"ELSE user_email END || ' | ' || {usd('total_cost_usd')} || ' | ' "
    f"|| {usd('avg_daily_cost_usd')} || ' |'")}
UNION ALL SELECT 'cost_summary', 3, seq, line FROM (
  SELECT unnest([0, 1]) AS seq,
         unnest([E'\\n### Trend', CASE WHEN change IS NULL
                   THEN 'Latest period: ' || {usd('cost')}
                   ELSE CASE WHEN change > 0 THEN '📈' WHEN change < 0 THEN '📉' ELSE '➡️' END
                        || ' Latest period: ' || {usd('cost')} || ' (' || {text('change', 1)}
                        || '% vs prior)' END]) AS line
  FROM (SELECT count(*) AS n, arg_max(total_cost_usd, period) AS cost,
               arg_max_null(pct_change_vs_prior, period) AS change
        FROM ({trend("CAST(date_trunc('week', usage_date) AS DATE)")}))
  WHERE n >= 2)"""

# The wording and names below equal the operators'.
REPORT_FINDINGS = f"""
reported AS (
  SELECT severity, daily_cost_usd AS cost,
         '- **COST_SPIKE** (cost: ' || {usd('daily_cost_usd')} || '; +'
           || {text('pct_above_baseline', 1)} || '% vs baseline; target: ' || dim_value || ')'
           AS line FROM ({SPIKES_WORKSPACE})
  UNION ALL SELECT severity, total_cost_usd, '- **IDLE_CLUSTER_RISK**' FROM ({IDLE_CLUSTERS})
  UNION ALL SELECT severity, total_cost_usd, '- **' || headline || '**' FROM ({UNTAGGED})
),
severities AS (
  SELECT * FROM (VALUES (1, 'CRITICAL', '🔥'), (2, 'HIGH', '⚠️'), (3, 'MEDIUM', '🟡'),
                        (4, 'LOW', 'ℹ️')) t(section, severity, marker)
),
counted AS (
  SELECT section, severity, marker, count(*) AS n
  FROM reported JOIN severities USING (severity) GROUP BY ALL
)"""

FINDING_LINES = """
SELECT 'findings' AS report, 0 AS section, 0 AS seq,
       CASE WHEN count(*) = 0
            THEN E'## 🚨 Findings\\n\\n_No anomalies or policy violations detected._'
            ELSE '## 🚨 Findings (' || count(*) || E' total)\\n' END AS line FROM reported
UNION ALL SELECT 'findings', section, 0,
       E'\\n### ' || marker || ' ' || severity || ' (' || n || ')' FROM counted
UNION ALL SELECT 'findings', section, CAST(rank AS INTEGER), line
FROM (SELECT section, line,
             row_number() OVER (PARTITION BY severity ORDER BY cost DESC, line) AS rank
      FROM reported JOIN severities USING (severity)) WHERE rank <= 10
UNION ALL SELECT 'findings', section, 11, '- _...and ' || (n - 10) || ' more_'
FROM counted WHERE n > 10"""

# The wording and names below equal the operators'.
RECOMMENDATION_LINES = f"""
SELECT 'recommendations' AS report, 0 AS section, seq, line FROM (
  SELECT unnest([0, 1]) AS seq,
         unnest(['## 💡 Optimization Recommendations (' || count(*) || ' total)',
                 E'\\n**Estimated total monthly savings: '
                   || {usd('sum(CAST(expected_savings_usd_monthly AS DECIMAL(28,8)))')}
                   || E'**\\n']) AS line FROM recommended)
UNION ALL SELECT 'recommendations', 1, CAST(rank * 10 + pos - 1 AS INTEGER), lines[pos]
FROM (SELECT rank, unnest([1, 2, 3]) AS pos,
             [E'\\n**' || rank || '. ' || title || '**  ',
              '_Savings:_ ' || {usd('expected_savings_usd_monthly')} || '/mo · _Confidence:_ '
                || confidence || '  ', rationale] AS lines
      FROM (SELECT *, row_number() OVER (
                     ORDER BY expected_savings_usd_monthly DESC, title, rationale) AS rank
            FROM recommended) WHERE rank <= 15)
UNION ALL SELECT 'recommendations', 2, 0, E'\\n_...and ' || (count(*) - 15) || ' more_'
FROM recommended HAVING count(*) > 15"""

oracle("cost_summary_report", COST_LINES)
oracle("findings_report", FINDING_LINES, REPORT_FINDINGS)
oracle("recommendations_report", RECOMMENDATION_LINES, EVERY_RECOMMENDATION)
oracle("report_text", f"""
SELECT report, string_agg(line, E'\\n' ORDER BY section, seq) AS markdown
FROM (SELECT * FROM ({COST_LINES}) UNION ALL SELECT * FROM ({FINDING_LINES})
      UNION ALL SELECT * FROM ({RECOMMENDATION_LINES})) GROUP BY report""",
       REPORT_FINDINGS + "," + EVERY_RECOMMENDATION)

# ------------------------------------------------- model answers and chargeback

MONEY = "CAST(CAST(value AS DECIMAL(12,2)) AS VARCHAR)"
FULL_ITEM = f"""'{{"action_type": "rightsize", "confidence": "high", "effort": "low", '
  || '"estimated_monthly_savings_usd": ' || {MONEY} || ', "finding_id": "finding-' || user_id
  || '", "rationale": "uses ' || event_type || '", "suggested_command": null, "title": "Resize '
  || event_type || '"}}'"""

PARSED = f"""
parsed AS (
  SELECT sha256(event_id || '|' || item_no) AS recommendation_id, event_id AS response_id,
         CASE WHEN has_finding THEN 'finding-' || user_id ELSE '' END AS finding_ids,
         CASE WHEN complete THEN 'rightsize' ELSE 'investigate' END AS action_type,
         CASE WHEN complete THEN 'Resize ' || event_type
              WHEN long_title THEN repeat('long ', 60)
              ELSE 'Investigate finding' END AS title,
         CASE WHEN complete THEN 'uses ' || event_type ELSE '' END AS rationale,
         CASE WHEN complete OR long_title THEN CAST({MONEY} AS DOUBLE) ELSE 0 END
           AS estimated_monthly_savings_usd,
         CASE WHEN complete THEN 'high' ELSE 'medium' END AS confidence,
         CASE WHEN complete THEN 'low' ELSE 'medium' END AS effort,
         CASE WHEN has_finding AND user_id % 10 <> 9 THEN 'ws-' || (user_id % 5)
              ELSE 'unknown' END AS target_resource,
         CAST(NULL AS VARCHAR) AS suggested_command, '2001-07-20 00:00:00' AS created_at
  FROM (SELECT *, 0 AS item_no, event_id % 6 IN (0, 1) AS complete, false AS long_title,
               true AS has_finding
        FROM events WHERE event_id % 6 IN (0, 1, 3)
        UNION ALL SELECT *, 1, false, true, false FROM events WHERE event_id % 6 = 0)
)"""
oracle("parse_llm_recommendations", "SELECT * FROM parsed", PARSED)

oracle("persist_parsed_recommendations", """
SELECT recommendation_id, 'run-1' AS run_id, '2001-07-20 06:01:30' AS created_at,
       action_type AS recommendation_type, CAST(NULL AS VARCHAR) AS resource_type,
       target_resource AS resource_id, CAST(NULL AS VARCHAR) AS resource_name,
       CAST(NULL AS VARCHAR) AS workspace_id, title, rationale,
       estimated_monthly_savings_usd AS expected_savings_usd_monthly,
       upper(confidence) AS confidence, CAST(NULL AS DOUBLE) AS priority_score,
       CAST(NULL AS VARCHAR) AS priority_tier,
       '{"suggested_command":null,"finding_ids":['
         || CASE WHEN finding_ids = '' THEN '' ELSE '"' || finding_ids || '"' END || ']}'
         AS implementation_steps,
       CAST(NULL AS VARCHAR) AS risks, 'PROPOSED' AS status,
       CAST(NULL AS VARCHAR) AS accepted_by, CAST(NULL AS VARCHAR) AS implemented_at,
       CAST(NULL AS DOUBLE) AS actual_savings_usd
FROM parsed""", PARSED)

oracle("persist_run", f"""
SELECT 'run-1' AS run_id, CAST(NULL AS VARCHAR) AS job_run_id,
       '2001-07-20 06:00:00' AS started_at, '2001-07-20 06:01:30' AS ended_at,
       'FAILED' AS status, 'manual' AS triggered_by, 'daily' AS mode, 'false' AS dry_run,
       CAST(90 AS INTEGER) AS lookback_days, '["load: none"]' AS error_message,
       CAST(90 AS DOUBLE) AS duration_seconds,
       CAST((SELECT count(*) FROM {EVERY_FINDING}) AS INTEGER) AS findings_count,
       CAST((SELECT count(*) FROM parsed) AS INTEGER) AS recommendations_count,
       CAST((SELECT count(*) FROM run_calls) AS INTEGER) AS llm_calls,
       CAST(coalesce((SELECT sum(k) FROM run_calls), 0) AS BIGINT) AS llm_tokens,
       (SELECT total_cost_usd FROM metrics) AS total_cost_usd,
       CAST(90 AS INTEGER) AS config_days, CAST(1.5 AS DOUBLE) AS analyze_ms,
       (SELECT string_agg(line, E'\\n' ORDER BY section, seq) FROM ({COST_LINES}))
         AS report_markdown""",
       RUN_CTES + "," + PARSED + """,
run_calls AS (
  SELECT CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events
  WHERE user_id = 1 AND event_type <> 'error' AND event_id % 5 <> 0
)""")

oracle("extract_json_object", f"""
SELECT event_id AS response_id,
       CASE event_id % 6 WHEN 0 THEN NULL WHEN 3 THEN sparse ELSE item END AS json_text,
       CASE WHEN event_id % 6 <> 0 THEN 'true' ELSE 'false' END AS is_valid,
       CASE WHEN event_id % 6 = 0 THEN 'Invalid JSON from LLM' END AS error_message
FROM (SELECT *, {FULL_ITEM} AS item,
             '{{"action_type": null, "estimated_monthly_savings_usd": "soon", "finding_id": '
               || '"finding-' || user_id || '"}}' AS sparse
      FROM events)""")

oracle("llm_usage_rollup", f"""
SELECT run_id, endpoint, count(*) FILTER (ok) AS calls, count(*) FILTER (NOT ok) AS failures,
       CAST(coalesce(sum(k - k // 3) FILTER (ok), 0) AS BIGINT) AS prompt_tokens,
       CAST(coalesce(sum(k // 3) FILTER (ok), 0) AS BIGINT) AS completion_tokens,
       CAST(coalesce(sum(k) FILTER (ok), 0) AS BIGINT) AS total_tokens,
       coalesce({r(mean('sum(latency) FILTER (ok)', 'count(*) FILTER (ok)'))}, 0)
         AS avg_latency_seconds
FROM (SELECT 'run-' || user_id AS run_id, event_type AS endpoint,
             CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
             CAST(value AS DECIMAL(28,8)) AS latency,
             event_type <> 'error' AND event_id % 5 <> 0 AS ok
      FROM events) GROUP BY run_id, endpoint""")

oracle("team_chargeback", f"""
SELECT t.team, t.usage_month, total_cost_usd, untagged_cost_usd, last_month_cost_usd,
       CASE WHEN last_month_cost_usd > 0 THEN
         {r('(total_cost_usd - last_month_cost_usd) / last_month_cost_usd * 100', 1)} END
         AS pct_change_vs_last_month, top_drivers
FROM (SELECT a.*, b.total_cost_usd AS last_month_cost_usd FROM bills a LEFT JOIN bills b
        ON a.team = b.team AND b.month_start = a.month_start - INTERVAL 1 MONTH) t
LEFT JOIN (SELECT team, usage_month,
                  string_agg(resource_type || ':' || resource_id || ':' || {text('cost')} || ':'
                               || {text('untagged')}, '; ' ORDER BY rank) AS top_drivers
           FROM (SELECT *, row_number() OVER (PARTITION BY team, usage_month
                          ORDER BY cost DESC, resource_type, resource_id) AS rank
                 FROM drivers WHERE cost > 0) WHERE rank <= 3 GROUP BY team, usage_month) d
  ON t.team = d.team AND t.usage_month = d.usage_month""", f"""
drivers AS (
  SELECT tag_team AS team, usage_month, resource_type, resource_id,
         sum(estimated_cost_usd) AS cost,
         coalesce(sum(estimated_cost_usd) FILTER (
           'untagged' IN (tag_environment, tag_project, tag_team)), 0) AS untagged
  FROM silver GROUP BY ALL
),
bills AS (
  SELECT tag_team AS team, usage_month, CAST(usage_month || '-01' AS DATE) AS month_start,
         {r('sum(estimated_cost_usd)')} AS total_cost_usd,
         coalesce({r("sum(estimated_cost_usd) FILTER ('untagged' IN (tag_environment, tag_project, tag_team))")}, 0)
           AS untagged_cost_usd
  FROM silver GROUP BY ALL
)""")

X = "(CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice - 250000 END)"
OLD_NEW = "((200000.0::DOUBLE - amount) / abs(amount) * 100)"
UNITS = ["B", "KB", "MB", "GB", "TB", "PB"]
BYTES = "CASE " + " ".join(
    f"WHEN size < {1024 ** (i + 1)}::DOUBLE THEN {text(f'size / {1024 ** i}::DOUBLE')} || ' {u}'"
    for i, u in enumerate(UNITS)
) + f" ELSE {text(f'size / {1024 ** 6}::DOUBLE')} || ' EB' END"
oracle("format_functions", f"""
SELECT o_orderkey, {usd('x')} AS usd, {usd('o_totalprice', 0)} AS usd_whole,
       coalesce({text('x / 1000000 * 100', 1)} || '%', 'N/A') AS pct,
       CASE WHEN o_orderkey % 5 = 0 OR amount = 0 THEN 'N/A'
            ELSE CASE WHEN 200000 >= amount THEN '+' ELSE '' END || {text(OLD_NEW, 1)} || '%' END
         AS pct_change,
       CASE WHEN x IS NULL THEN '0'
            WHEN x / 100 >= 1000 THEN {text('x / 100 / 1000', 1)} || 'K DBU'
            ELSE {text('x / 100', 1)} || ' DBU' END AS dbu,
       {BYTES} AS bytes,
       CASE WHEN s = 0 THEN '0s' ELSE concat_ws(' ',
         CASE WHEN s // 86400 <> 0 THEN (s // 86400) || 'd' END,
         CASE WHEN s % 86400 // 3600 <> 0 THEN (s % 86400 // 3600) || 'h' END,
         CASE WHEN s % 3600 // 60 <> 0 THEN (s % 3600 // 60) || 'm' END,
         CASE WHEN s % 60 <> 0 AND s // 86400 = 0 THEN (s % 60) || 's' END) END AS duration,
       CASE WHEN length(label) > 9 THEN substr(label, 1, 6) || '...' ELSE label END AS short,
       {AS_OF} - 5 AS day
FROM (SELECT *, {X} AS x, o_totalprice AS amount, o_orderkey * 37 AS s,
             o_orderpriority || ' ' || o_orderstatus AS label,
             (CAST(o_orderkey AS DOUBLE) + 1) * CASE WHEN o_orderkey % 14 < 8
               THEN pow(16, o_orderkey % 14) ELSE 1099511627776::DOUBLE END AS size
      FROM orders)""")
