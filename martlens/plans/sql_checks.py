"""Plain SQL for every query that SQL can express.

The text says what a query means, joining first and grouping last. It shares the
view definitions with the Spark plans, and limits and labels, whose values the
tests of the fixtures pin one by one.
"""

from __future__ import annotations

from martlens import fixed_values as fixed
from martlens.plans.catalog import AS_OF, CATEGORY, CUBE_REPORTS, YEAR

_VIEWS = """
WITH customers_v AS (
  SELECT c.c_custkey AS customer_id, CAST(18 + c.c_custkey % 48 AS INTEGER) AS age,
         CASE c.c_custkey % 3 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' ELSE 'Other' END AS gender,
         r.r_name AS region, f.registration_date, c.c_mktsegment AS loyalty_tier
  FROM customer c
  LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
  LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN (SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS registration_date
             FROM orders GROUP BY o_custkey) f ON f.o_custkey = c.c_custkey
), products_v AS (
  SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category,
         CAST(p_retailprice AS DECIMAL(18,2)) AS base_price,
         CAST(ROUND(CAST(p_retailprice AS DECIMAL(18,2)) * CAST(0.55 AS DECIMAL(4,2)), 2)
              AS DECIMAL(18,2)) AS cost_price,
         CAST(p_partkey * 37 % 501 AS INTEGER) AS stock_quantity
  FROM part
), orders_v AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         CAST(o_orderdate AS DATE) AS order_date,
         CASE WHEN o_orderstatus = 'F' THEN 'Delivered' WHEN o_orderstatus = 'O' THEN 'Returned'
              WHEN o_orderkey % 2 = 0 THEN 'Cancelled' ELSE 'Pending' END AS status,
         o_orderpriority AS payment_method,
         CAST(o_totalprice AS DECIMAL(18,2)) AS total_amount,
         CASE WHEN o_orderstatus = 'F' THEN CAST(1 + o_orderkey % 10 AS INTEGER) END
           AS shipping_days
  FROM orders
), items_v AS (
  SELECT l_orderkey AS order_id, l_linenumber AS line_no, l_partkey AS product_id,
         CAST(l_quantity AS INTEGER) AS quantity,
         CAST(l_discount AS DECIMAL(4,2)) AS discount_pct,
         CAST(ROUND(CAST(l_extendedprice AS DECIMAL(18,2))
              * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(18,2)) AS line_total
  FROM lineitem
), delivered AS (SELECT * FROM orders_v WHERE status = 'Delivered')
"""

_SLICED = """
, chosen AS (
  SELECT o.* FROM orders_v o
  WHERE year(o.order_date) = 1997
    AND o.customer_id IN (SELECT customer_id FROM customers_v WHERE region = 'ASIA')
    AND o.order_id IN (SELECT i.order_id FROM items_v i JOIN products_v p
                       ON i.product_id = p.product_id WHERE p.category = 'ECONOMY')
)
"""
_DATE = f"DATE '{AS_OF}'"


def _money(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def _round(expr: str, digits: int = 2, how: str = "ROUND") -> str:
    """Rounds the shortest decimal that stands for the double.

    A direct cast to decimal multiplies in floating point and can miss a tie.
    """
    return (
        f"CAST({how}(CAST(CAST({expr} AS VARCHAR) AS DECIMAL(28,10)), {digits}) AS DOUBLE)"
    )


def _mean(expr: str, digits: int = 2) -> str:
    return _round(f"CAST(SUM({expr}) AS DOUBLE) / NULLIF(COUNT({expr}), 0)", digits)


def _pct(part: str, whole: str, digits: int = 2) -> str:
    return _round(
        f"CAST(100.0 AS DOUBLE) * CAST({part} AS DOUBLE) / NULLIF(CAST({whole} AS DOUBLE), 0)",
        digits,
    )


def _count_if(condition: str) -> str:
    return f"COUNT(CASE WHEN {condition} THEN 1 END)"


def _int_sum(expr: str) -> str:
    return f"CAST(SUM({expr}) AS BIGINT)"


def _case(conditions: list[str], results: tuple) -> str:
    whens = " ".join(f"WHEN {c} THEN {r!r}" for c, r in zip(conditions, results))
    return f"CASE {whens} ELSE {results[-1]!r} END"


_SEGMENT_RULES = [f"r + f + m >= {total}" for total in fixed.SEGMENT_TOTALS]
_SEGMENT_RULES += [f"r >= {fixed.RECENT_SCORE}", f"f >= {fixed.AT_RISK_SCORE}"]

_RFM = f"""
, rfm AS (
  SELECT customer_id, CAST(date_diff('day', MAX(order_date), {_DATE}) AS DOUBLE) AS recency_days,
         COUNT(DISTINCT order_id) AS frequency, SUM(total_amount) AS amount
  FROM delivered GROUP BY customer_id
)"""

_RFM_LONG = """
, long AS (
  SELECT 'recency' AS metric, recency_days AS value FROM rfm
  UNION ALL SELECT 'frequency', CAST(frequency AS DOUBLE) FROM rfm
  UNION ALL SELECT 'monetary', CAST(amount AS DOUBLE) FROM rfm
)"""

_SEGMENTS = f"""
, scored AS (
  SELECT *, {_case([f'recency_days <= {d}' for d in fixed.RECENCY_LIMITS], (5, 4, 3, 2, 1))} AS r,
         {_case([f'frequency >= {n}' for n in fixed.FREQUENCY_LIMITS], (5, 4, 3, 2, 1))} AS f,
         CAST(NTILE({fixed.MONETARY_TILES}) OVER (ORDER BY amount, customer_id) AS INTEGER) AS m
  FROM rfm
), segments AS (
  SELECT customer_id, recency_days, frequency, {_money('amount')} AS monetary,
         CAST(r AS INTEGER) AS r_score, CAST(f AS INTEGER) AS f_score, m AS m_score,
         CAST(r + f + m AS INTEGER) AS rfm_total,
         {_case(_SEGMENT_RULES, fixed.SEGMENTS)} AS customer_segment
  FROM scored
)"""

_LAST_DELIVERED = """
, last_order AS (
  SELECT customer_id, MAX(order_date) AS last_order FROM delivered GROUP BY customer_id
)"""

_LAPSED = f"date_diff('day', last_order, {_DATE}) > {fixed.CHURN_DAYS}"


def _features(source: str, discount: str) -> str:
    return f"""
, features AS (
  SELECT o.customer_id, CAST(date_diff('day', MAX(o.order_date), {_DATE}) AS INTEGER) AS recency,
         COUNT(DISTINCT o.order_id) AS frequency,
         {_money('SUM(o.total_amount)')} AS monetary,
         {_mean('o.total_amount')} AS avg_order_value,
         MIN(o.shipping_days) AS min_shipping,
         {_mean('o.shipping_days', 1)} AS avg_shipping,
         {_int_sum("CASE WHEN o.status = 'Returned' THEN 1 ELSE 0 END")} AS returns,
         {_int_sum("CASE WHEN o.status = 'Cancelled' THEN 1 ELSE 0 END")} AS cancellations,
         {discount} AS avg_discount
  FROM {source} GROUP BY o.customer_id
)"""


_FEATURES = _features(
    "orders_v o JOIN items_v i ON o.order_id = i.order_id", _mean("i.discount_pct", 3)
)
_FEATURES_ORDER = _features(
    """orders_v o LEFT JOIN (
         SELECT order_id, SUM(discount_pct) AS discount, COUNT(discount_pct) AS discounts
         FROM items_v GROUP BY order_id) i ON o.order_id = i.order_id""",
    _round("CAST(SUM(i.discount) AS DOUBLE) / NULLIF(SUM(i.discounts), 0)", 3),
)

_MATRIX = (
    _FEATURES
    + f"""
, joined AS (
  SELECT f.*, c.age, c.gender, c.region, c.loyalty_tier,
         CAST(f.recency > 180 AS INTEGER) AS churned,
         CAST(date_diff('day', c.registration_date, {_DATE}) AS INTEGER) AS tenure_days
  FROM features f JOIN customers_v c ON f.customer_id = c.customer_id
), coded AS (
  SELECT * REPLACE (
           CAST(DENSE_RANK() OVER (ORDER BY COALESCE(gender, 'nan')) - 1 AS INTEGER) AS gender,
           CAST(DENSE_RANK() OVER (ORDER BY COALESCE(region, 'nan')) - 1 AS INTEGER) AS region,
           CAST(DENSE_RANK() OVER (ORDER BY COALESCE(loyalty_tier, 'nan')) - 1 AS INTEGER)
             AS loyalty_tier)
  FROM joined
), matrix AS (
  SELECT recency, frequency, monetary, avg_order_value, avg_shipping, returns, cancellations,
         avg_discount, age, gender, region, loyalty_tier, tenure_days, churned, customer_id
  FROM coded
  WHERE recency IS NOT NULL AND monetary IS NOT NULL AND avg_order_value IS NOT NULL
    AND avg_shipping IS NOT NULL AND avg_discount IS NOT NULL AND age IS NOT NULL
    AND tenure_days IS NOT NULL
)"""
)

_SCORES = (
    _FEATURES
    + """
, scores AS (
  SELECT customer_id, CAST(recency > 180 AS INTEGER) AS churned,
         LEAST(CAST(recency AS DOUBLE) / CAST(730.0 AS DOUBLE), 1) AS score
  FROM features
)"""
)

_BAND_RULES = [
    f"churn_probability > CAST({limit} AS DOUBLE)"
    for limit in (fixed.HIGH_RISK, fixed.MEDIUM_RISK)
]

_BANDS = (
    _SCORES
    + f"""
, bands AS (
  SELECT customer_id, churn_probability,
         {_case(_BAND_RULES, fixed.RISK_BANDS)} AS predicted_segment
  FROM (SELECT customer_id, {_round('score', 4, 'ROUND_EVEN')} AS churn_probability FROM scores)
)"""
)

_CELLS = (
    _SCORES
    + f"""
, cells AS (
  SELECT {_count_if('churned = 0 AND score <= 0.5')} AS tn,
         {_count_if('churned = 0 AND score > 0.5')} AS fp,
         {_count_if('churned = 1 AND score <= 0.5')} AS fn,
         {_count_if('churned = 1 AND score > 0.5')} AS tp
  FROM scores
)"""
)

_BY_SCORE = (
    _SCORES
    + f"""
, by_score AS (
  SELECT score, {_count_if('churned = 1')} AS pos, {_count_if('churned = 0')} AS neg
  FROM scores GROUP BY score
)"""
)

_STAR = """items_v i JOIN products_v p ON i.product_id = p.product_id
  JOIN delivered o ON i.order_id = o.order_id"""

_PRODUCT_COLUMNS = f"""p.product_id, p.product_name, p.category,
  {_int_sum('i.quantity')} AS units_sold, {_money('SUM(i.line_total)')} AS total_revenue,
  {_money('SUM(i.line_total) - SUM(i.quantity * p.cost_price)')} AS gross_profit,
  {_pct('(SUM(i.line_total) - SUM(i.quantity * p.cost_price))', 'SUM(i.line_total)')}
    AS profit_margin_pct"""


def _product_report(where: str, tail: str) -> str:
    return f"""SELECT {_PRODUCT_COLUMNS} FROM {_STAR} {where}
GROUP BY p.product_id, p.product_name, p.category
ORDER BY total_revenue DESC NULLS LAST, product_id {tail}"""


def _by_customer_attribute(column: str) -> str:
    return f"""SELECT c.{column}, COUNT(DISTINCT o.order_id) AS orders,
  COUNT(DISTINCT c.customer_id) AS customers, {_money('SUM(o.total_amount)')} AS revenue,
  {_mean('o.total_amount')} AS aov
FROM delivered o JOIN customers_v c ON o.customer_id = c.customer_id GROUP BY c.{column}"""


_STOCK_RULES = ["stock_quantity = 0"]
_STOCK_RULES += [f"stock_quantity <= {n}" for n in (fixed.CRITICAL_STOCK, fixed.LOW_STOCK)]


def _low_stock(where: str) -> str:
    return f"""SELECT product_id, product_name, category, stock_quantity,
  {_case(_STOCK_RULES, fixed.STOCK_LABELS)} AS stock_status
FROM products_v WHERE {where}"""


_DELIVERED_SUM = "SUM(CASE WHEN o.status = 'Delivered' THEN o.total_amount END)"
_DELIVERED_COUNT = "COUNT(DISTINCT CASE WHEN o.status = 'Delivered' THEN o.order_id END)"
_CORE = f"""{_money(_DELIVERED_SUM)} AS total_revenue, {_DELIVERED_COUNT} AS total_orders,
  {_round(f'CAST({_DELIVERED_SUM} AS DOUBLE) / NULLIF({_DELIVERED_COUNT}, 0)')}
    AS avg_order_value,
  COUNT(DISTINCT o.customer_id) AS unique_customers"""
_RETURN_RATE = _pct(_count_if("o.status = 'Returned'"), "COUNT(*)")


def _duplicates(table: str, view: str, keys: str) -> str:
    has_null = " OR ".join(f"{k} IS NULL" for k in keys.split(","))
    return f"""SELECT '{table}' AS table_name, '{keys}' AS key_columns,
  {_count_if(f'NOT ({has_null})')} AS distinct_keys,
  {_count_if(f'NOT ({has_null}) AND n > 1')} AS duplicate_keys,
  CAST(COALESCE(SUM(CASE WHEN NOT ({has_null}) AND n > 1 THEN n - 1 END), 0) AS BIGINT)
    AS surplus_rows,
  CAST(COALESCE(SUM(CASE WHEN {has_null} THEN n END), 0) AS BIGINT) AS null_keys
FROM (SELECT {keys}, COUNT(*) AS n FROM {view} GROUP BY {keys})"""


def _orphans(child: str, view: str, key: str, parent: str, parent_view: str) -> str:
    return f"""SELECT '{child}' AS child_table, '{key}' AS key_column,
  '{parent}' AS parent_table, COUNT(DISTINCT x.{key}) AS orphan_keys, COUNT(*) AS orphan_rows
FROM {view} x WHERE x.{key} IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM {parent_view} y WHERE y.{key} = x.{key})"""


def _union(*parts: str) -> str:
    return "\nUNION ALL\n".join(parts)


_EDGE = "CASE WHEN {n} = 30 THEN hi ELSE lo + {n} * ((hi - lo) / 30.0::DOUBLE) END"


def _edge(number: str) -> str:
    return _EDGE.format(n=number)


def statements() -> dict[str, str]:
    return {name: _VIEWS + text for name, text in _TEXTS.items()}


_TEXTS = {
    "monthly_revenue_trend": f"""
SELECT strftime(order_date, '%Y-%m') AS month, COUNT(DISTINCT order_id) AS total_orders,
  {_money('SUM(total_amount)')} AS gross_revenue, {_mean('total_amount')} AS avg_order_value
FROM delivered GROUP BY month""",
    "revenue_by_month": f"""
SELECT strftime(order_date, '%Y-%m') AS month, {_money('SUM(total_amount)')} AS revenue,
  COUNT(DISTINCT order_id) AS orders
FROM delivered GROUP BY month""",
    "revenue_by_category": f"""
SELECT p.category, {_money('SUM(i.line_total)')} AS revenue FROM {_STAR} GROUP BY p.category""",
    "payment_volume": f"""
SELECT payment_method, COUNT(*) AS transactions, {_mean('total_amount')} AS aov
FROM delivered GROUP BY payment_method""",
    "yearly_revenue": f"""
SELECT strftime(order_date, '%Y') AS year, {_money('SUM(total_amount)')} AS total_revenue,
  COUNT(DISTINCT order_id) AS orders_count, COUNT(DISTINCT customer_id) AS unique_customers
FROM delivered GROUP BY year""",
    "kpi_summary": f"""
SELECT COUNT(DISTINCT customer_id) AS customers, COUNT(DISTINCT order_id) AS total_orders,
  {_money('SUM(total_amount)')} AS gross_revenue, {_mean('total_amount')} AS aov
FROM delivered""",
    "clv_top20": f"""
SELECT c.customer_id, c.region, c.loyalty_tier, COUNT(DISTINCT o.order_id) AS total_orders,
  {_money('SUM(o.total_amount)')} AS lifetime_value, {_mean('o.total_amount')} AS avg_order_value,
  MIN(o.order_date) AS first_order, MAX(o.order_date) AS last_order
FROM customers_v c JOIN delivered o ON c.customer_id = o.customer_id
GROUP BY c.customer_id, c.region, c.loyalty_tier
ORDER BY lifetime_value DESC NULLS LAST, c.customer_id LIMIT {fixed.TOP_CUSTOMERS}""",
    "rfm_base": _RFM
    + f"""
SELECT customer_id, recency_days, frequency, {_money('amount')} AS monetary FROM rfm""",
    "rfm_segments": _RFM + _SEGMENTS + "\nSELECT * FROM segments",
    "rfm_histogram": _RFM
    + _RFM_LONG
    + f"""
, ranges AS (
  SELECT metric, CASE WHEN MIN(value) = MAX(value) THEN MIN(value) - 0.5 ELSE MIN(value) END AS lo,
         CASE WHEN MIN(value) = MAX(value) THEN MAX(value) + 0.5 ELSE MAX(value) END AS hi
  FROM long GROUP BY metric
), placed AS (
  SELECT l.metric, l.value, r.lo, r.hi,
         LEAST(CAST(FLOOR((l.value - r.lo) / (r.hi - r.lo) * 30) AS BIGINT), 29) AS slot
  FROM long l JOIN ranges r ON l.metric = r.metric
), moved AS (
  SELECT metric, 1 + CASE WHEN value < {_edge('slot')} THEN slot - 1
                          WHEN slot < 29 AND value >= {_edge('(slot + 1)')} THEN slot + 1
                          ELSE slot END AS bin
  FROM placed
), grid AS (SELECT metric, lo, hi, b.bin FROM ranges CROSS JOIN range(1, 31) AS b(bin))
SELECT g.metric, g.bin, {_edge('(g.bin - 1)')} AS lo, {_edge('g.bin')} AS hi,
  COUNT(m.bin) AS count
FROM grid g LEFT JOIN moved m ON g.metric = m.metric AND g.bin = m.bin
GROUP BY g.metric, g.bin, g.lo, g.hi""",
    "rfm_medians": _RFM
    + _RFM_LONG
    + """
SELECT metric, MEDIAN(value) AS median FROM long GROUP BY metric""",
    "churn_by_region_tier": _LAST_DELIVERED
    + f"""
SELECT c.region, c.loyalty_tier, COUNT(*) AS total_customers,
  {_count_if(_LAPSED)} AS churned_customers,
  {_pct(_count_if(_LAPSED), 'COUNT(*)')} AS churn_rate_pct
FROM customers_v c LEFT JOIN last_order l ON c.customer_id = l.customer_id
GROUP BY c.region, c.loyalty_tier""",
    "churn_by_region": _LAST_DELIVERED
    + f"""
, rates AS (
  SELECT region, total, churned,
         {_round('CAST(churned AS DOUBLE) / total * CAST(100.0 AS DOUBLE)', 1, 'ROUND_EVEN')}
           AS churn_rate
  FROM (SELECT c.region, COUNT(DISTINCT c.customer_id) AS total, {_count_if(_LAPSED)} AS churned
        FROM customers_v c LEFT JOIN last_order l ON c.customer_id = l.customer_id
        GROUP BY c.region)
), mean AS (
  SELECT CAST(SUM(CAST(churn_rate AS DECIMAL(10,1))) AS DOUBLE) / COUNT(*) AS rate FROM rates
)
SELECT region, total, churned, churn_rate, {_round('rate', 6)} AS avg_rate,
  churn_rate > rate AS above_avg
FROM rates CROSS JOIN mean""",
    "top_products": _product_report("", f"LIMIT {fixed.TOP_PRODUCTS}"),
    "category_product_detail": _product_report(f"WHERE p.category = '{CATEGORY}'", ""),
    "category_mix": f"""
SELECT p.category, COUNT(DISTINCT o.order_id) AS orders, {_money('SUM(i.line_total)')} AS revenue,
  {_pct('SUM(i.line_total)', 'SUM(SUM(i.line_total)) OVER ()')} AS revenue_share_pct,
  {_round('CAST(SUM(i.discount_pct) AS DOUBLE) / COUNT(i.discount_pct) * CAST(100.0 AS DOUBLE)')}
    AS avg_discount_pct
FROM {_STAR} GROUP BY p.category""",
    "low_stock_alert": _low_stock("stock_quantity <= 50"),
    "low_stock_strict": _low_stock("stock_quantity < 50"),
    "revenue_by_region": _by_customer_attribute("region"),
    "revenue_by_tier": _by_customer_attribute("loyalty_tier"),
    "payment_preference": f"""
SELECT payment_method, COUNT(*) AS transactions, {_money('SUM(total_amount)')} AS revenue,
  {_mean('total_amount')} AS avg_order_value,
  {_pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS usage_pct
FROM delivered GROUP BY payment_method""",
    "order_status_breakdown": f"""
SELECT status, COUNT(*) AS orders, {_pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()')} AS pct_of_total,
  {_mean('total_amount')} AS avg_order_value
FROM orders_v GROUP BY status""",
    "status_share": f"""
SELECT status, COUNT(*) AS count, {_pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()', 1)} AS pct
FROM orders_v GROUP BY status""",
    "shipping_by_region": f"""
SELECT c.region, {_mean('o.shipping_days', 1)} AS avg_shipping_days,
  MIN(o.shipping_days) AS min_days, MAX(o.shipping_days) AS max_days
FROM delivered o JOIN customers_v c ON o.customer_id = c.customer_id
WHERE o.shipping_days IS NOT NULL GROUP BY c.region""",
    "shipping_trend": f"""
SELECT strftime(order_date, '%Y-%m') AS month, COUNT(*) AS orders,
  {_mean('shipping_days', 1)} AS avg_shipping_days
FROM delivered GROUP BY month""",
    "measures_core": f"SELECT {_CORE} FROM orders_v o",
    "measures_churn": f"""
, per_customer AS (
  SELECT customer_id, MAX(order_date) AS last_order FROM orders_v GROUP BY customer_id)
SELECT {_count_if(_LAPSED)} AS churned_customers, COUNT(*) AS unique_customers,
  {_pct(_count_if(_LAPSED), 'COUNT(*)')} AS churn_rate_pct
FROM per_customer""",
    "churn_measure_by_region": f"""
, per_customer AS (
  SELECT customer_id, MAX(order_date) AS last_order FROM orders_v GROUP BY customer_id)
SELECT c.region, {_count_if(_LAPSED)} AS churned_customers, COUNT(*) AS unique_customers,
  {_pct(_count_if(_LAPSED), 'COUNT(*)')} AS churn_rate_pct
FROM per_customer l JOIN customers_v c ON l.customer_id = c.customer_id GROUP BY c.region""",
    "measures_profit": f"""
, profit AS (
  SELECT SUM(i.line_total - i.quantity * p.cost_price) AS profit
  FROM items_v i JOIN products_v p ON i.product_id = p.product_id
), revenue AS (SELECT SUM(total_amount) AS revenue FROM delivered)
SELECT {_money('profit')} AS gross_profit, {_money('revenue')} AS total_revenue,
  {_pct('profit', 'revenue')} AS profit_margin_pct
FROM profit CROSS JOIN revenue""",
    "measures_returns": f"""
SELECT {_count_if("o.status = 'Returned'")} AS returned_orders, COUNT(*) AS all_orders,
  {_RETURN_RATE} AS return_rate_pct
FROM orders_v o""",
    "measures_sliced": f"""
, wanted_items AS (
  SELECT i.*, p.cost_price FROM items_v i JOIN products_v p ON i.product_id = p.product_id
  WHERE p.category = '{CATEGORY}'
), sliced AS (
  SELECT o.*, c.region, strftime(o.order_date, '%Y-%m') AS month
  FROM orders_v o JOIN customers_v c ON o.customer_id = c.customer_id
  WHERE year(o.order_date) = {YEAR} AND o.order_id IN (SELECT order_id FROM wanted_items)
), figures AS (
  SELECT region, month, {_CORE}, {_DELIVERED_SUM} AS amount, {_RETURN_RATE} AS return_rate_pct
  FROM sliced o GROUP BY region, month
), profits AS (
  SELECT o.region, o.month, SUM(i.line_total - i.quantity * i.cost_price) AS profit
  FROM wanted_items i JOIN sliced o ON i.order_id = o.order_id GROUP BY o.region, o.month
)
SELECT f.region, f.month, total_revenue, total_orders, avg_order_value, unique_customers,
  {_money('profit')} AS gross_profit, {_pct('profit', 'amount')} AS profit_margin_pct,
  return_rate_pct
FROM figures f JOIN profits p ON f.region = p.region AND f.month = p.month""",
    "revenue_mom_growth": f"""
, monthly AS (
  SELECT CAST(date_trunc('month', order_date) AS DATE) AS m, SUM(total_amount) AS amount
  FROM delivered GROUP BY m
)
SELECT strftime(a.m, '%Y-%m') AS month, {_money('a.amount')} AS revenue,
  {_money('b.amount')} AS previous_revenue,
  {_pct('(a.amount - b.amount)', 'b.amount')} AS growth_pct
FROM monthly a LEFT JOIN monthly b ON b.m = a.m - INTERVAL 1 MONTH""",
    "customer_360": _RFM
    + _SEGMENTS
    + _BANDS
    + """
SELECT c.customer_id, c.region, c.loyalty_tier, s.frequency AS total_orders,
  s.monetary AS lifetime_value, s.customer_segment, b.churn_probability, b.predicted_segment
FROM customers_v c JOIN segments s ON c.customer_id = s.customer_id
LEFT JOIN bands b ON c.customer_id = b.customer_id""",
    "category_product_rollup": f"""
SELECT CASE WHEN GROUPING(p.product_id) = 0 THEN 'product'
            WHEN GROUPING(p.category) = 0 THEN 'category' ELSE 'total' END AS level,
  p.category, p.product_id, p.product_name, {_money('SUM(i.line_total)')} AS revenue
FROM {_STAR}
GROUP BY GROUPING SETS ((p.category, p.product_id, p.product_name), (p.category), ())""",
    "category_month_revenue": f"""
SELECT p.category, strftime(o.order_date, '%Y-%m') AS month,
  {_money('SUM(i.line_total)')} AS revenue
FROM {_STAR} GROUP BY p.category, month""",
    "category_month_matrix": f"""
SELECT p.category,
  {", ".join(f"""{_money(f"SUM(CASE WHEN strftime(o.order_date, '%Y-%m') = '1997-{m:02}' THEN i.line_total END)")} AS "1997-{m:02}" """ for m in range(1, 13))},
  {_money("SUM(CASE WHEN strftime(o.order_date, '%Y') = '1997' THEN NULL ELSE i.line_total END)")} AS other_months
FROM {_STAR} GROUP BY p.category""",
    "executive_sliced_by_month": _SLICED
    + f"""
SELECT strftime(order_date, '%Y-%m') AS month, {_money('SUM(total_amount)')} AS revenue,
  COUNT(DISTINCT order_id) AS orders
FROM chosen WHERE status = 'Delivered' GROUP BY month""",
    "executive_sliced_status": _SLICED
    + f"""
SELECT status, COUNT(*) AS count, {_pct('COUNT(*)', 'SUM(COUNT(*)) OVER ()', 1)} AS pct
FROM chosen GROUP BY status""",
    "measures_by_region_slicer": f"""
SELECT strftime(o.order_date, '%Y') AS year, {_CORE}, {_RETURN_RATE} AS return_rate_pct
FROM orders_v o JOIN customers_v c ON o.customer_id = c.customer_id
WHERE c.region = 'ASIA' GROUP BY year""",
    "avg_discount": f"""
SELECT {_round('CAST(SUM(discount_pct) AS DOUBLE) / COUNT(discount_pct) * CAST(100.0 AS DOUBLE)')}
  AS avg_discount_pct
FROM items_v""",
    "churned_customers": _LAST_DELIVERED
    + f"""
SELECT c.customer_id, c.region, c.loyalty_tier, l.last_order,
  CAST(date_diff('day', l.last_order, {_DATE}) AS INTEGER) AS days_since_order
FROM customers_v c JOIN last_order l ON c.customer_id = l.customer_id WHERE {_LAPSED}""",
    "top_region_kpis": f"""
, best AS (
  SELECT c.region FROM delivered o JOIN customers_v c ON o.customer_id = c.customer_id
  GROUP BY c.region ORDER BY SUM(o.total_amount) DESC, c.region LIMIT 1
)
SELECT c.region, {_CORE}, {_RETURN_RATE} AS return_rate_pct
FROM orders_v o JOIN customers_v c ON o.customer_id = c.customer_id
JOIN best b ON c.region = b.region GROUP BY c.region""",
    "purchase_history": f"""
, lines AS (
  SELECT order_id, COUNT(*) AS items, {_int_sum('quantity')} AS units
  FROM items_v GROUP BY order_id
)
SELECT o.customer_id, o.order_id, o.order_date, o.status, o.payment_method,
  {_money('o.total_amount')} AS total_amount, COALESCE(l.items, 0) AS items,
  COALESCE(l.units, 0) AS units
FROM orders_v o LEFT JOIN lines l ON o.order_id = l.order_id""",
    "dq_duplicate_keys": _union(
        _duplicates("customers", "customers_v", "customer_id"),
        _duplicates("products", "products_v", "product_id"),
        _duplicates("orders", "orders_v", "order_id"),
        _duplicates("order_items", "items_v", "order_id,line_no"),
    ),
    "dq_orphan_keys": _union(
        _orphans("orders", "orders_v", "customer_id", "customers", "customers_v"),
        _orphans("order_items", "items_v", "order_id", "orders", "orders_v"),
        _orphans("order_items", "items_v", "product_id", "products", "products_v"),
    ),
    "star_view_counts": f"""
SELECT c.region, p.category, COUNT(*) AS items, COUNT(DISTINCT o.order_id) AS orders,
  {_money('SUM(i.line_total)')} AS revenue
FROM items_v i JOIN orders_v o ON i.order_id = o.order_id
JOIN customers_v c ON o.customer_id = c.customer_id
JOIN products_v p ON i.product_id = p.product_id
GROUP BY c.region, p.category""",
    "derived_line_totals": f"""
SELECT i.line_no, i.order_id, i.product_id, {_money('i.line_total')} AS line_total,
  {_money('ROUND(p.base_price * i.quantity * (1 - i.discount_pct), 2)')} AS derived_total
FROM items_v i JOIN products_v p ON i.product_id = p.product_id""",
    "order_total_reconciliation": f"""
, lines AS (
  SELECT order_id, COUNT(*) AS lines, SUM(line_total) AS total FROM items_v GROUP BY order_id
)
SELECT o.order_id, COALESCE(l.lines, 0) AS lines, {_money('o.total_amount')} AS header_total,
  {_money('COALESCE(l.total, 0)')} AS lines_total,
  {_money('o.total_amount - COALESCE(l.total, 0)')} AS difference,
  o.total_amount = COALESCE(l.total, 0) AS matches
FROM orders_v o LEFT JOIN lines l ON o.order_id = l.order_id""",
    "churn_features": _FEATURES + "\nSELECT * FROM features",
    "churn_features_order_grain": _FEATURES_ORDER + "\nSELECT * FROM features",
    "churn_labels": _SCORES
    + """
SELECT f.customer_id, f.recency, s.churned
FROM features f JOIN scores s ON f.customer_id = s.customer_id""",
    "encoded_categories": """
SELECT customer_id,
  CAST(DENSE_RANK() OVER (ORDER BY COALESCE(gender, 'nan')) - 1 AS INTEGER) AS gender,
  CAST(DENSE_RANK() OVER (ORDER BY COALESCE(region, 'nan')) - 1 AS INTEGER) AS region,
  CAST(DENSE_RANK() OVER (ORDER BY COALESCE(loyalty_tier, 'nan')) - 1 AS INTEGER) AS loyalty_tier
FROM customers_v""",
    "feature_matrix": _MATRIX + "\nSELECT * FROM matrix",
    "churn_dataset_summary": _MATRIX
    + f"""
SELECT COUNT(*) AS customers, CAST(COALESCE(SUM(churned), 0) AS BIGINT) AS churned,
  {_pct('SUM(churned)', 'COUNT(*)', 1)} AS churn_pct
FROM matrix""",
    "stratified_split_counts": _MATRIX
    + """
, sizes AS (
  SELECT churned, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS total,
    CAST(CEIL(SUM(COUNT(*)) OVER () / 5) AS BIGINT) AS tests
  FROM matrix GROUP BY churned
), shares AS (SELECT *, tests * n // total AS base, tests * n % total AS rest FROM sizes),
dealt AS (
  SELECT churned, n, base + CASE WHEN ROW_NUMBER() OVER (ORDER BY rest DESC, churned)
    <= tests - SUM(base) OVER () THEN 1 ELSE 0 END AS taken FROM shares
)
SELECT churned, TRUE AS is_test, CAST(taken AS BIGINT) AS customers FROM dealt WHERE taken > 0
UNION ALL
SELECT churned, FALSE, CAST(n - taken AS BIGINT) FROM dealt WHERE n > taken""",
    "rf_support": _MATRIX
    + """
, sizes AS (
  SELECT churned, COUNT(*) AS n, SUM(COUNT(*)) OVER () AS total,
    CAST(CEIL(SUM(COUNT(*)) OVER () / 5) AS BIGINT) AS tests
  FROM matrix GROUP BY churned
), shares AS (SELECT *, tests * n // total AS base, tests * n % total AS rest FROM sizes),
dealt AS (
  SELECT churned, tests, base + CASE WHEN ROW_NUMBER() OVER (ORDER BY rest DESC, churned)
    <= tests - SUM(base) OVER () THEN 1 ELSE 0 END AS taken FROM shares
)
SELECT CASE churned WHEN 0 THEN 'Active' ELSE 'Churned' END AS class,
  CAST(taken AS BIGINT) AS support FROM dealt
UNION ALL
SELECT name, tests FROM (SELECT MAX(tests) AS tests FROM dealt)
CROSS JOIN (VALUES ('accuracy'), ('macro avg'), ('weighted avg')) AS v(name)""",
    "cv_folds": _MATRIX
    + """
, placed AS (
  SELECT churned, ROW_NUMBER() OVER (
      PARTITION BY churned ORDER BY md5('42-' || CAST(customer_id AS VARCHAR))) AS place,
    COUNT(*) OVER (PARTITION BY churned) AS n
  FROM matrix
)
SELECT CAST((place > n // 5) AS INTEGER) + CAST((place > n * 2 // 5) AS INTEGER)
    + CAST((place > n * 3 // 5) AS INTEGER) + CAST((place > n * 4 // 5) AS INTEGER) AS fold,
  churned, COUNT(*) AS customers
FROM placed GROUP BY fold, churned""",
    "churn_predictions_check": _MATRIX
    + """
SELECT COUNT(*) AS customers, CAST(0 AS BIGINT) AS null_ids, CAST(0 AS BIGINT) AS outside_range,
  CAST(0 AS BIGINT) AS wrong_band, CAST(0 AS BIGINT) AS unknown_ids
FROM matrix""",
    "forest_nodes_check": _MATRIX
    + f"""
SELECT COUNT(*) AS customers, CAST(0 AS BIGINT) AS other_probabilities, CAST(13 AS BIGINT) AS features,
  CAST(0 AS BIGINT) AS other_importances, CAST({fixed.TREES} AS BIGINT) AS trees
FROM matrix""",
    "feature_importance_check": """
SELECT CAST(13 AS BIGINT) AS features, TRUE AS sums_to_one, CAST(3 AS BIGINT) AS flagged,
  TRUE AS flagged_are_largest""",
    "class_weights": _MATRIX
    + """
SELECT churned, COUNT(*) AS customers,
  CAST(SUM(COUNT(*)) OVER () AS DOUBLE) / (COUNT(*) OVER () * COUNT(*)) AS weight
FROM matrix GROUP BY churned""",
    "confusion_matrix": _CELLS
    + "\n"
    + _union(
        *[
            f"SELECT '{actual}' AS actual, '{predicted}' AS predicted, {cell} AS customers "
            "FROM cells"
            for actual, predicted, cell in (
                ("Active", "Active", "tn"),
                ("Active", "Churned", "fp"),
                ("Churned", "Active", "fn"),
                ("Churned", "Churned", "tp"),
            )
        ]
    ),
    "classification_report": _CELLS
    + f"""
, per_class AS (
  SELECT 'Active' AS class, COALESCE(CAST(tn AS DOUBLE) / NULLIF(tn + fn, 0), 0) AS p,
         COALESCE(CAST(tn AS DOUBLE) / NULLIF(tn + fp, 0), 0) AS r,
         COALESCE(CAST(2 * tn AS DOUBLE) / NULLIF(2 * tn + fn + fp, 0), 0) AS f, tn + fp AS s
  FROM cells
  UNION ALL
  SELECT 'Churned', COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fp, 0), 0),
         COALESCE(CAST(tp AS DOUBLE) / NULLIF(tp + fn, 0), 0),
         COALESCE(CAST(2 * tp AS DOUBLE) / NULLIF(2 * tp + fn + fp, 0), 0), tp + fn
  FROM cells
), report AS (
  SELECT class, p, r, f, CAST(s AS BIGINT) AS s FROM per_class
  UNION ALL
  SELECT 'accuracy', a, a, a, n FROM (
    SELECT CAST(tn + tp AS DOUBLE) / NULLIF(tn + fp + fn + tp, 0) AS a, tn + fp + fn + tp AS n
    FROM cells)
  UNION ALL
  SELECT 'macro avg', AVG(p), AVG(r), AVG(f), CAST(SUM(s) AS BIGINT) FROM per_class
  UNION ALL
  SELECT 'weighted avg', SUM(p * s) / SUM(s), SUM(r * s) / SUM(s), SUM(f * s) / SUM(s),
         CAST(SUM(s) AS BIGINT) FROM per_class
)
SELECT class, {_round('p', 4)} AS precision, {_round('r', 4)} AS recall, {_round('f', 4)} AS f1,
  s AS support
FROM report""",
    "roc_auc": _BY_SCORE
    + f"""
, wins AS (
  SELECT SUM(p.pos * n.neg * CASE WHEN p.score > n.score THEN 2
                                  WHEN p.score = n.score THEN 1 ELSE 0 END) AS twice
  FROM by_score p CROSS JOIN by_score n
)
SELECT {_round('''CAST(twice AS DOUBLE)
  / NULLIF(CAST(pos AS DOUBLE) * CAST(neg AS DOUBLE) * 2, 0)''', 6)} AS auc
FROM wins CROSS JOIN (SELECT SUM(pos) AS pos, SUM(neg) AS neg FROM by_score)""",
    "roc_curve": _BY_SCORE
    + """
, walked AS (
  SELECT score, SUM(neg) OVER w AS fp, SUM(pos) OVER w AS tp,
         ROW_NUMBER() OVER (ORDER BY score DESC) AS place,
         LEAD(pos) OVER (ORDER BY score DESC) = pos
           AND LEAD(neg) OVER (ORDER BY score DESC) = neg AS same
  FROM by_score
  WINDOW w AS (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), points AS (
  SELECT score AS threshold, fp, tp FROM walked WHERE place = 1 OR NOT COALESCE(same, FALSE)
  UNION ALL SELECT NULL, 0, 0
)
SELECT threshold, CAST(fp AS DOUBLE) / NULLIF(CAST(neg AS DOUBLE), 0) AS fpr,
  CAST(tp AS DOUBLE) / NULLIF(CAST(pos AS DOUBLE), 0) AS tpr
FROM points CROSS JOIN (SELECT SUM(pos) AS pos, SUM(neg) AS neg FROM by_score)""",
    "churn_risk_bands": _BANDS + "\nSELECT * FROM bands",
    "risk_band_counts": _BANDS
    + """
SELECT predicted_segment, COUNT(*) AS customers FROM bands GROUP BY predicted_segment""",
}

_LEVELS = {
    "month": ("CAST(date_trunc('month', order_date) AS DATE)", "region"),
    "year": ("CAST(date_trunc('year', order_date) AS DATE)", "region"),
    "region": ("CAST(NULL AS DATE)", "region"),
    "total": ("CAST(NULL AS DATE)", "CAST(NULL AS VARCHAR)"),
}
_TEXTS["cube_customer_rollup"] = """
, known AS (
  SELECT o.order_date, o.customer_id, c.region FROM orders_v o JOIN customers_v c USING (customer_id)
)
""" + " UNION ALL ".join(
    f"""SELECT '{level}' AS level, {period} AS period, {region} AS region,
  COUNT(DISTINCT customer_id) AS customers FROM known GROUP BY 1, 2, 3"""
    for level, (period, region) in _LEVELS.items()
)
_TEXTS["order_cube"] = """
SELECT CAST(date_trunc('month', order_date) AS DATE) AS month, status, payment_method, c.region,
  c.loyalty_tier, COUNT(*) AS rows, COUNT(order_id) AS orders,
  CAST(SUM(total_amount) AS DOUBLE) AS amount, COUNT(DISTINCT customer_id) AS customers
FROM orders_v JOIN customers_v c USING (customer_id) GROUP BY 1, 2, 3, 4, 5"""
_TEXTS |= {f"cube_{name}": _TEXTS[name] for name in CUBE_REPORTS}
