"""Independent SQL for every named query (DuckDB dialect).

The text rebuilds the whole chain from the raw tables: the fixture mapping,
cleaning, feature tables, then the query itself.  It shares no code with
the Spark operators, so agreement is evidence for both.
"""

from __future__ import annotations

ORDER = ("event_time NULLS LAST, product_id NULLS FIRST, event_type NULLS FIRST, price NULLS FIRST, "
         "user_id NULLS FIRST, brand NULLS FIRST, category_code NULLS FIRST")

FIXTURE = """
b AS (
  SELECT CASE WHEN l_orderkey % 97 = 0 THEN NULL ELSE concat('s', l_orderkey) END AS user_session,
         o_custkey AS user_id,
         CASE l_returnflag WHEN 'N' THEN 'view' WHEN 'A' THEN 'cart' ELSE 'purchase' END AS event_type,
         l_partkey AS product_id,
         CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_brand END AS brand,
         CASE WHEN p_partkey % 13 = 0 THEN NULL
              ELSE concat(lower(p_type), '.', replace(p_name, ' ', '.')) END AS category_code,
         CASE WHEN l_orderkey % 101 = 0 THEN NULL ELSE
           CAST(CAST(CAST(l_quantity AS BIGINT) * (1 + l_partkey % 20) * 100 + l_orderkey % 100 AS DECIMAL(20,2))
                * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2)) END AS price,
         CASE WHEN l_partkey % 211 = 0 THEN NULL ELSE
           CAST(o_orderdate AS TIMESTAMP) + ((l_orderkey * 7) % 1440) * INTERVAL '1' MINUTE
                       + ((l_linenumber - 1) * ((l_orderkey % 13) * 37)) * INTERVAL '1' SECOND END AS event_time,
         l_orderkey AS k
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey
),
raw AS (
  SELECT user_session, user_id, event_type, product_id, brand, category_code, price, event_time FROM b
  UNION ALL
  SELECT user_session, user_id, event_type, product_id, brand, category_code, price, event_time FROM b WHERE k % 50 = 0
)"""

EVENTS_FIXTURE = """
raw AS (
  SELECT concat(CAST(e.user_id AS VARCHAR), '-', strftime(e.ts, '%Y%m%d')) AS user_session,
         e.user_id,
         CASE WHEN e.event_type = 'click' THEN 'cart' ELSE e.event_type END AS event_type,
         CAST(json_extract_string(e.props, '$.k') AS BIGINT) AS product_id,
         p.p_brand AS brand,
         concat(lower(p.p_type), '.', replace(p.p_name, ' ', '.')) AS category_code,
         CAST(e.value AS DECIMAL(18,2)) AS price,
         CAST(e.ts AS TIMESTAMP) AS event_time
  FROM events e LEFT JOIN part p ON p.p_partkey = CAST(json_extract_string(e.props, '$.k') AS BIGINT)
)"""


def _chain(types: tuple[str, ...]) -> str:
    uniq = ",\n".join(
        f"    CAST(count(DISTINCT CASE WHEN event_type = '{t}' THEN product_id END) AS BIGINT) AS {t}_unique"
        for t in sorted(types))
    ent = lambda key: ",\n".join(
        f"    CAST(count(DISTINCT CASE WHEN event_type = '{t}' THEN product_id END) AS BIGINT) AS \"{t}\""
        for t in sorted(types))
    return f"""
dd AS (SELECT DISTINCT * FROM raw),
ev0 AS (
  SELECT user_id, user_session, event_type, product_id, coalesce(brand, 'unknown') AS brand,
         category_code, price, event_time,
         CAST(hour(event_time) AS INTEGER) AS hour,
         CAST(isodow(event_time) - 1 AS INTEGER) AS weekday,
         CAST(month(event_time) AS INTEGER) AS month,
         CASE WHEN hour(event_time) >= 0 AND hour(event_time) < 6 THEN 'night'
              WHEN hour(event_time) >= 6 AND hour(event_time) < 12 THEN 'morning'
              WHEN hour(event_time) >= 12 AND hour(event_time) < 18 THEN 'afternoon'
              WHEN hour(event_time) >= 18 AND hour(event_time) < 24 THEN 'evening' END AS event_period,
         CASE WHEN event_type = 'purchase' THEN price ELSE CAST(0 AS DECIMAL(18,2)) END AS purchase_spending
  FROM dd WHERE user_session IS NOT NULL
),
ev1 AS (
  SELECT *,
         min(event_time) OVER (PARTITION BY user_session) AS session_start,
         lag(event_time) OVER (PARTITION BY user_session ORDER BY {ORDER}) AS prev_t,
         row_number() OVER (PARTITION BY user_session ORDER BY {ORDER}) AS seq
  FROM ev0
),
ev AS (
  SELECT *, (epoch_us(event_time) - epoch_us(session_start)) / 1e6 AS time_since_start,
         coalesce((epoch_us(event_time) - epoch_us(prev_t)) / 1e6, 0.0) AS prev_event_gap
  FROM ev1
),
sess0 AS (
  SELECT user_session,
    arg_min(user_id, seq) FILTER (WHERE user_id IS NOT NULL) AS user_id,
    arg_min(category_code, seq) FILTER (WHERE category_code IS NOT NULL) AS category_code,
    arg_min(brand, seq) FILTER (WHERE brand IS NOT NULL) AS brand,
    CAST(count_if(event_type = 'view') AS BIGINT) AS view_count,
    CAST(count_if(event_type = 'cart') AS BIGINT) AS cart_count,
    CAST(count_if(event_type = 'purchase') AS BIGINT) AS purchase_count,
    CAST(count(DISTINCT brand) AS BIGINT) AS n_unique_brands,
    CAST(count(DISTINCT category_code) AS BIGINT) AS n_unique_categories,
    min(event_time) AS session_started_at,
    max(event_time) AS session_ended_at,
    coalesce(sum(purchase_spending), 0) AS session_total_spending,
{uniq}
  FROM ev GROUP BY user_session
),
sessions AS (
  SELECT *,
    (epoch_us(session_ended_at) - epoch_us(session_started_at)) / 1e6 AS session_duration,
    coalesce(CAST(purchase_unique AS DOUBLE) / nullif(view_unique, 0), 0.0) AS view_to_purchase_rate,
    coalesce(isodow(session_started_at) - 1 >= 5, false) AS is_weekend
  FROM sess0
),
users AS (
  SELECT user_id,
    CAST(count(*) AS BIGINT) AS user_total_sessions,
    CAST(sum(view_count) AS BIGINT) AS total_view_count,
    CAST(sum(cart_count) AS BIGINT) AS total_cart_count,
    CAST(sum(purchase_count) AS BIGINT) AS total_purchase_count,
    CAST(sum(purchase_unique) AS BIGINT) AS total_unique_purchase_count,
    CAST(sum(view_unique) AS BIGINT) AS total_unique_view_count,
    -- mean duration rounded half-even to the microsecond, in exact integers
    CASE WHEN count(session_duration) > 0 THEN
      CAST((sum(dur_us) // count(session_duration)
            + CASE WHEN 2 * (sum(dur_us) % count(session_duration)) > count(session_duration) THEN 1
                   WHEN 2 * (sum(dur_us) % count(session_duration)) = count(session_duration)
                        THEN (sum(dur_us) // count(session_duration)) % 2
                   ELSE 0 END) AS DOUBLE) / 1e6 END AS user_avg_session_duration,
    coalesce(sum(session_total_spending), 0) AS user_total_spending,
    least(coalesce(CAST(sum(purchase_unique) AS DOUBLE) / nullif(sum(view_unique), 0), 0.0), 1.0)
      AS user_view_to_purchase_rate,
    coalesce(CAST(sum(purchase_count) AS DOUBLE) / nullif(count(*), 0), 0.0) AS user_purchase_per_session
  FROM (SELECT *, epoch_us(session_ended_at) - epoch_us(session_started_at) AS dur_us FROM sessions)
  GROUP BY user_id
),
brands AS (
  SELECT brand,
{ent('brand')},
    coalesce(CAST(count(DISTINCT CASE WHEN event_type = 'purchase' THEN product_id END) AS DOUBLE)
             / nullif(count(DISTINCT CASE WHEN event_type = 'view' THEN product_id END), 0), 0.0)
      AS brand_view_to_purchase_rate,
    coalesce(sum(CASE WHEN event_type = 'purchase' THEN purchase_spending END), 0) AS purchase_spending
  FROM ev WHERE brand IS NOT NULL GROUP BY brand
),
categories AS (
  SELECT category_code,
{ent('category_code')},
    coalesce(CAST(count(DISTINCT CASE WHEN event_type = 'purchase' THEN product_id END) AS DOUBLE)
             / nullif(count(DISTINCT CASE WHEN event_type = 'view' THEN product_id END), 0), 0.0)
      AS category_view_to_purchase_rate,
    coalesce(sum(CASE WHEN event_type = 'purchase' THEN purchase_spending END), 0) AS purchase_spending
  FROM ev WHERE category_code IS NOT NULL GROUP BY category_code
)"""


# The orders fixture with some of its events only.
_FILTERS = {
    "orders-browsing": "event_type = 'view'",
    "orders-weekend": "event_type <> 'purchase' OR coalesce(isodow(event_time) >= 6, false)",
}


def with_chain(body: str, source: str = "orders") -> str:
    """Full SQL text: fixture -> cleaning -> features -> ``body``."""
    if source == "events":
        return ("WITH " + EVENTS_FIXTURE.strip() + ",\n"
                + _chain(("view", "cart", "purchase", "error", "signup")).strip() + "\n" + body)
    fixture = FIXTURE.strip()
    if source in _FILTERS:
        fixture = fixture.replace("\nraw AS (", "\nall_raw AS (") + f",\nraw AS (SELECT * FROM all_raw WHERE {_FILTERS[source]})"
    return "WITH " + fixture + ",\n" + _chain(("view", "cart", "purchase")).strip() + "\n" + body
