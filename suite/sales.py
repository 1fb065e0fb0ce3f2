"""The 29 named reports and the catalogue."""

from __future__ import annotations

from sievelark.operators import sales
from suite.inputs import TRANSACTIONS_SQL, dated, nudged, rounded, transactions

QUERIES = {}
ORACLES = {}


def _add(name, report, sql, dates=(), places=2):
    QUERIES[name] = lambda spark, sf: rounded(dated(report(transactions(spark, sf)), *dates), places)
    ORACLES[name] = f"WITH {TRANSACTIONS_SQL.strip()} {nudged(sql)}"


_add("q01_total_revenue", sales.total_revenue, "SELECT near(sum(amount), 2) AS total_revenue FROM t")
_add("q02_average_transaction_value", sales.average_transaction_value,
     "SELECT near(avg(amount), 2) AS avg_value FROM t")
_add("q03_transaction_count", sales.transaction_count,
     "SELECT count(*) AS total_transactions, count(DISTINCT customer_id) AS unique_customers FROM t")
_add("q04_customer_segmentation", sales.customer_segmentation, """
SELECT customer_id, count(*) AS transaction_count, near(sum(amount), 2) AS total_spent,
  near(avg(amount), 2) AS avg_transaction,
  date_diff('day', min(transaction_date), max(transaction_date)) AS days_as_customer,
  CASE WHEN sum(amount) >= 5000 THEN 'Premium' WHEN sum(amount) >= 1000 THEN 'Gold'
       WHEN sum(amount) >= 100 THEN 'Silver' ELSE 'Bronze' END AS segment
FROM t GROUP BY customer_id""")
_add("q05_repeat_customers", sales.repeat_customers, """
SELECT customer_id, count(*) AS purchase_count,
  count(DISTINCT CAST(transaction_date AS DATE)) AS purchase_days,
  CAST(min(transaction_date) AS DATE) AS first_purchase, CAST(max(transaction_date) AS DATE) AS last_purchase
FROM t GROUP BY customer_id HAVING count(*) > 1""", ("first_purchase", "last_purchase"))
_add("q06_customer_retention", sales.customer_retention, """
, p AS (SELECT DISTINCT CAST(date_trunc('month', transaction_date) AS DATE) AS m, customer_id FROM t),
a AS (SELECT m, count(customer_id) AS n FROM p GROUP BY m),
r AS (SELECT c.m AS current_month, b.m AS previous_month, count(DISTINCT c.customer_id) AS retained_customers
      FROM p c LEFT JOIN p b ON c.customer_id = b.customer_id
       AND CAST(b.m + INTERVAL 1 MONTH AS DATE) = c.m GROUP BY 1, 2)
SELECT current_month, previous_month, retained_customers,
  round(100.0::DOUBLE * retained_customers / n, 2) AS retention_rate
FROM r LEFT JOIN a ON a.m = r.previous_month""")
_add("q07_customer_lifetime_value", sales.customer_lifetime_value, """
, c AS (SELECT customer_id, sum(amount) AS v, count(*) AS n, avg(amount) AS a,
        date_diff('day', min(transaction_date), max(transaction_date)) AS d FROM t GROUP BY 1)
SELECT customer_id, near(v, 2) AS lifetime_value, n AS total_purchases, near(a, 2) AS avg_purchase,
  d AS customer_lifetime_days, round(v / nullif(d, 0), 2) AS daily_value FROM c""")
_add("q08_sales_by_region", sales.sales_by_region, """
SELECT region, count(*) AS transaction_count, near(sum(amount), 2) AS total_sales,
  near(avg(amount), 2) AS avg_sale, near(min(amount), 2) AS min_sale, near(max(amount), 2) AS max_sale
FROM t GROUP BY region""")
_add("q09_sales_by_category", sales.sales_by_category, """
SELECT category, count(*) AS transaction_count, near(sum(amount), 2) AS total_sales,
  near(avg(amount), 2) AS avg_sale,
  round(100.0 * sum(amount) / (SELECT sum(amount) FROM t), 2) AS percent_of_total
FROM t WHERE category IS NOT NULL GROUP BY category""")
_add("q10_top_products", sales.top_products, """
, s AS (SELECT product_id, product_name, count(*) AS times_sold, sum(amount) AS r, avg(amount) AS a
        FROM t GROUP BY 1, 2)
SELECT product_id, product_name, times_sold, near(r, 2) AS total_revenue, near(a, 2) AS avg_price, rank
FROM (SELECT *, row_number() OVER (ORDER BY r DESC, product_id) AS rank FROM s) WHERE rank <= 20""")
_add("q11_top_customers", sales.top_customers, """
, s AS (SELECT customer_id, customer_name, count(*) AS purchase_count, sum(amount) AS r FROM t GROUP BY 1, 2)
SELECT customer_id, customer_name, purchase_count, near(r, 2) AS total_spent, rank
FROM (SELECT *, row_number() OVER (ORDER BY r DESC, customer_id) AS rank FROM s) WHERE rank <= 20""")
_add("q12_monthly_sales_trend", sales.monthly_sales_trend, """
SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS month, count(*) AS transaction_count,
  near(sum(amount), 2) AS total_sales, near(avg(amount), 2) AS avg_transaction,
  near(min(amount), 2) AS min_transaction, near(max(amount), 2) AS max_transaction FROM t GROUP BY 1""")
_add("q13_month_over_month_growth", sales.month_over_month_growth, """
, m AS (SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS month, sum(amount) AS s FROM t GROUP BY 1)
SELECT c.month, near(c.s, 2) AS total_sales, near(p.s, 2) AS previous_month_sales,
  round((c.s - p.s) / nullif(p.s, 0) * 100, 2) AS growth_rate_pct
FROM m c LEFT JOIN m p ON CAST(p.month + INTERVAL 1 MONTH AS DATE) = c.month""")
_add("q14_year_over_year_growth", sales.year_over_year_growth, """
, m AS (SELECT year(transaction_date) AS y, month(transaction_date) AS m, sum(amount) AS s FROM t GROUP BY 1, 2)
SELECT c.m AS month, c.y AS current_year, near(c.s, 2) AS current_year_sales,
  near(p.s, 2) AS previous_year_sales, round((c.s - p.s) / nullif(p.s, 0) * 100, 2) AS yoy_growth_rate
FROM m c LEFT JOIN m p ON c.m = p.m AND c.y = p.y + 1""")
_add("q15_daily_sales_summary", sales.daily_sales_summary, """
SELECT CAST(transaction_date AS DATE) AS sale_date, count(*) AS transaction_count,
  count(DISTINCT customer_id) AS unique_customers, near(sum(amount), 2) AS total_sales,
  near(avg(amount), 2) AS avg_transaction, near(max(amount), 2) AS max_transaction FROM t GROUP BY 1""")
_TIES = "transaction_date, customer_id, product_id, amount, quantity, cost"
_DOWN = ", ".join(f"{c} DESC" for c in _TIES.split(", "))
_WINDOWS = f"""
, w AS (SELECT transaction_date, amount, sum(amount) OVER (ORDER BY transaction_date) AS running,
        sum(amount) OVER (ORDER BY {_TIES} ROWS BETWEEN 30 PRECEDING AND CURRENT ROW) AS rolling,
        row_number() OVER (ORDER BY {_DOWN}) AS place FROM t)
SELECT CAST(transaction_date AS DATE) AS transaction_date, near(amount, 2) AS amount,
  near(running, 2) AS running_total, near(rolling, 2) AS rolling_30day_total FROM w"""
_add("q16_running_total_sales", sales.running_total_sales, f"{_WINDOWS} WHERE place <= 1000",
     ("transaction_date",))
_add("w1_running_total_all_rows", lambda t: sales.running_total_sales(t, limit=None), _WINDOWS,
     ("transaction_date",))
_add("w1_running_total_split", lambda t: sales.running_total_sales(t, limit=None, group_rows=20_000),
     _WINDOWS, ("transaction_date",))
_RANKS = """
SELECT customer_id, CAST(transaction_date AS DATE) AS transaction_date, near(amount, 2) AS amount,
  row_number() OVER (PARTITION BY customer_id
    ORDER BY transaction_date DESC, amount DESC, product_id DESC, quantity DESC, cost DESC) AS purchase_sequence,
  rank() OVER (PARTITION BY customer_id ORDER BY amount DESC) AS amount_rank,
  ntile(4) OVER (PARTITION BY customer_id
    ORDER BY amount, transaction_date, product_id, quantity, cost) AS quartile
FROM t"""
_add("q17_sales_rank_by_customer", sales.sales_rank_by_customer, _RANKS, ("transaction_date",))
_add("q17_sales_rank_split", lambda t: sales.sales_rank_by_customer(t, group_rows=50), _RANKS,
     ("transaction_date",))
_add("q18_percentile_sales", sales.percentile_sales, """
SELECT category, near(quantile_cont(amount, 0.25), 2) AS q1, near(quantile_cont(amount, 0.5), 2) AS median,
  near(quantile_cont(amount, 0.75), 2) AS q3, near(quantile_cont(amount, 0.9), 2) AS p90,
  near(quantile_cont(amount, 0.95), 2) AS p95 FROM t GROUP BY category""")
ORACLES["q18_percentile_search"] = ORACLES["q18_percentile_sales"]
QUERIES["q18_percentile_search"] = lambda spark, sf: rounded(
    sales.percentile_sales(transactions(spark, sf), limit=1000))
_add("q19_lag_lead_analysis", sales.lag_lead_analysis, """
, w AS (SELECT *, lag(amount) OVER c AS before, lead(amount) OVER c AS after,
          lead(transaction_date) OVER c AS next_date FROM t
        WINDOW c AS (PARTITION BY customer_id ORDER BY transaction_date, product_id, amount, quantity, cost))
SELECT customer_id, CAST(transaction_date AS DATE) AS transaction_date, near(amount, 2) AS amount,
  near(before, 2) AS previous_amount, near(after, 2) AS next_amount,
  date_diff('day', transaction_date, next_date) AS days_to_next_purchase,
  near(amount - before, 2) AS change_from_previous
FROM w WHERE before IS NOT NULL OR after IS NOT NULL""", ("transaction_date",))
ORACLES["q19_lag_lead_split"] = ORACLES["q19_lag_lead_analysis"]
QUERIES["q19_lag_lead_split"] = lambda spark, sf: rounded(dated(
    sales.lag_lead_analysis(transactions(spark, sf), group_rows=50), "transaction_date"))
_add("q20_revenue_distribution", sales.revenue_distribution, """
SELECT CASE WHEN amount < 50 THEN 'Under $50' WHEN amount < 100 THEN '$50-$100'
            WHEN amount < 500 THEN '$100-$500' WHEN amount < 1000 THEN '$500-$1000'
            ELSE 'Over $1000' END AS revenue_bucket, count(*) AS transaction_count,
  count(DISTINCT customer_id) AS unique_customers, near(sum(amount), 2) AS total_revenue,
  near(avg(amount), 2) AS avg_revenue FROM t GROUP BY 1""")
_add("q21_transaction_frequency", sales.transaction_frequency, """
, c AS (SELECT customer_id, count(*) AS n,
        date_diff('day', min(transaction_date), max(transaction_date)) AS d FROM t GROUP BY 1)
SELECT CASE WHEN n = 1 THEN 'One-Time' WHEN n BETWEEN 2 AND 5 THEN 'Occasional'
            WHEN n BETWEEN 6 AND 20 THEN 'Regular' ELSE 'Frequent' END AS frequency_category,
  count(*) AS customer_count, round(avg(n), 2) AS avg_transactions, round(avg(d), 2) AS avg_days_active
FROM c GROUP BY 1""")
_add("q22_cohort_analysis", sales.cohort_analysis, """
, f AS (SELECT customer_id, date_trunc('month', min(transaction_date)) AS cohort FROM t GROUP BY 1),
x AS (SELECT t.customer_id, cohort, date_diff('month', cohort, date_trunc('month', transaction_date)) AS k
      FROM t JOIN f ON t.customer_id = f.customer_id)
SELECT CAST(cohort AS DATE) AS cohort_month, k AS months_since_first,
  count(DISTINCT customer_id) AS customer_count FROM x GROUP BY 1, 2""")
_add("q23_customer_churn_analysis", sales.customer_churn_analysis, """
, p AS (SELECT DISTINCT CAST(date_trunc('month', transaction_date) AS DATE) AS m, customer_id FROM t),
f AS (SELECT customer_id, min(m) AS first_m FROM p GROUP BY 1)
SELECT m AS current_month, count(*) AS active_customers,
  CAST(sum(CASE WHEN m = first_m THEN 1 ELSE 0 END) AS BIGINT) AS new_customers,
  CAST(sum(CASE WHEN m > first_m THEN 1 ELSE 0 END) AS BIGINT) AS returning_customers
FROM p JOIN f ON p.customer_id = f.customer_id GROUP BY 1""")
_add("q24_profit_analysis", sales.profit_analysis, """
SELECT category, count(*) AS transaction_count, near(sum(amount), 2) AS total_revenue,
  near(sum(cost), 2) AS total_cost, near(sum(amount) - sum(cost), 2) AS total_profit,
  round(100.0 * (sum(amount) - sum(cost)) / sum(amount), 2) AS profit_margin_pct,
  near(avg(amount - cost), 2) AS avg_profit_per_transaction FROM t GROUP BY category""")
_add("q25_profit_by_region", sales.profit_by_region, """
SELECT region, near(sum(amount), 2) AS revenue, near(sum(cost), 2) AS cost,
  near(sum(amount) - sum(cost), 2) AS profit,
  round(100.0 * (sum(amount) - sum(cost)) / sum(amount), 2) AS profit_margin_pct,
  count(*) AS transaction_count FROM t GROUP BY region""")
_add("q26_inventory_turnover", sales.inventory_turnover, """
SELECT product_id, product_name, near(sum(quantity), 2) AS total_quantity_sold, count(*) AS times_sold,
  near(avg(quantity), 2) AS avg_quantity_per_sale,
  near(sum(amount) / nullif(sum(quantity), 0), 2) AS avg_price_per_unit FROM t GROUP BY 1, 2""")
_add("q27_customer_product_affinity", sales.customer_product_affinity, """
, c AS (SELECT customer_id, category, count(*) AS n, sum(amount) AS s FROM t GROUP BY 1, 2)
SELECT customer_id, category, n AS purchase_count, near(s, 2) AS total_spent, k AS category_rank
FROM (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY n DESC, category) AS k FROM c)
WHERE k <= 3""")
_add("q28_customer_summary_view", sales.create_view_customer_summary, """
SELECT customer_id, count(*) AS total_purchases, near(sum(amount), 2) AS total_spent,
  near(avg(amount), 2) AS avg_purchase, CAST(min(transaction_date) AS DATE) AS first_purchase,
  CAST(max(transaction_date) AS DATE) AS last_purchase,
  date_diff('day', min(transaction_date), max(transaction_date)) AS customer_lifetime_days
FROM t GROUP BY 1""", ("first_purchase", "last_purchase"))
_add("q29_monthly_kpis_view", sales.create_view_monthly_kpis, """
SELECT CAST(date_trunc('month', transaction_date) AS DATE) AS month, count(*) AS transaction_count,
  count(DISTINCT customer_id) AS unique_customers, near(sum(amount), 2) AS total_revenue,
  near(avg(amount), 2) AS avg_transaction, near(max(amount), 2) AS max_transaction FROM t GROUP BY 1""")
