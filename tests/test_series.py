import datetime as dt

import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from demandloom.operators import alerts as A
from demandloom.operators import inventory as N
from demandloom.operators import kpi as K
from demandloom.operators import series as S


def sales_of(spark, data):
    """data: (product_id, 'YYYY-MM-DD[ HH:MM:SS]', quantity[, price])."""
    out = [(p, dt.datetime.fromisoformat(d), float(q), float(rest[0]) if rest else 1.0, i) for i, (p, d, q, *rest) in enumerate(data)]
    return spark.createDataFrame(out, "product_id int, ds timestamp, quantity double, price_at_sale double, order_id int")


def products_of(spark, data):
    """data: (id, name, stock, safety, price, cost)."""
    schema = "id int, name string, current_stock int, safety_stock int, base_price double, unit_cost double"
    return spark.createDataFrame(data, schema).withColumn("category_id", F.lit(1))


def test_weeks_end_on_sunday_and_gaps_are_zero(spark):
    sales = sales_of(spark, [(1, "2024-12-30 23:59:59", 5), (1, "2025-01-05", 1), (1, "2025-01-20", 2), (2, "2024-02-29", 7)])
    out = S.resample(sales, "W", by=["product_id"])
    assert [(str(r[0]), r[1]) for r in out.filter("product_id = 1").orderBy("period_end").select("period_end", "quantity").collect()] == [
        ("2025-01-05", 6.0), ("2025-01-12", 0.0), ("2025-01-19", 0.0), ("2025-01-26", 2.0),
    ]
    assert rows(out.filter("product_id = 2"), "quantity") == [(7.0,)]


@pytest.mark.parametrize(
    "freq, first, last, count",
    [("D", "2023-11-30", "2024-03-01", 93), ("M", "2023-11-30", "2024-03-31", 5), ("Q", "2023-12-31", "2024-03-31", 2), ("Y", "2023-12-31", "2024-12-31", 2)],
)
def test_bucket_ends(spark, freq, first, last, count):
    out = S.resample(sales_of(spark, [(1, "2023-11-30", 1), (1, "2024-03-01", 2)]), freq)
    got = out.agg(F.min("period_end"), F.max("period_end"), F.count("*"), F.sum("quantity")).first()
    assert (str(got[0]), str(got[1]), got[2], got[3]) == (first, last, count, 3.0)


def test_unknown_frequency():
    with pytest.raises(ValueError):
        S.period_start(F.col("x"), "H")


def test_scope_keys(spark):
    days = [("2024-12-30",), ("2021-01-03",), ("2024-02-29",)]
    df = spark.createDataFrame(days, "d string").withColumn("ds", F.to_timestamp("d"))
    keys = rows(df.select("d", *[S.scope_key(F.col("ds"), s).alias(s) for s in ("day", "week", "month", "year", "other")]))
    assert keys[0] == ("2021-01-03", "2021-01-03", "2020-W53", "2021-01", "2021", "2021-01-03")
    assert keys[2][2] == "2025-W01"


def test_history_end_is_midnight(spark):
    sales = sales_of(spark, [(1, "2024-01-01", 1, 2), (1, "2024-01-31 08:00:00", 5, 2)])
    assert rows(S.product_sales_history(sales, "month", end="2024-01-31")) == [(1, "2024-01-31", 1, 2.0)]
    assert S.product_sales_history(sales, "5years").first()["date"] == "2024-12-31"


def test_trends_truncate(spark):
    sales = sales_of(spark, [(1, "2024-01-03", 1.9), (2, "2024-01-04", 8.0)])
    assert rows(S.demand_trends(sales, "month")) == [("2024-01-31", "Jan 31", 9, 10)]
    assert S.demand_trends(sales, "anything").first()["name"] == "Jan 07"


def test_lags_need_a_full_window(spark):
    data = [(1, f"2024-{m:02d}-15", m) for m in range(1, 6)]
    monthly = S.resample(sales_of(spark, data), "M", by=["product_id"])
    got = S.lag_features(monthly, "month").orderBy("period_end").select("prev_period_sales", "rollback_n").collect()
    assert [tuple(r) for r in got] == [(None, None), (1.0, None), (2.0, None), (3.0, 6.0), (4.0, 9.0)]
    assert S.lag_features(monthly, "year").filter("rollback_n is not null").count() == 0
    assert {"lag_1", "lag_3", "month"} <= set(S.ml_lags(monthly, (1, 3)).columns)


def test_future_dates(spark):
    monthly = S.resample(sales_of(spark, [(1, f"2023-{m:02d}-15", m) for m in (9, 10, 11, 12)]), "M", by=["product_id"])
    got = S.future_features(monthly, 2, "month").orderBy("period").collect()
    assert [str(r["date"]) for r in got] == ["2024-01-31", "2024-02-29"]
    # the rolling sum is that of the last row, which leaves out the last month
    assert (got[0]["prev_period_sales"], got[0]["rollback_n"], got[1]["prev_period_sales"]) == (12.0, 30.0, None)
    yearly = S.future_features(S.resample(sales_of(spark, [(1, "2023-05-05", 1)]), "Y", by=["product_id"]), 2, "year")
    assert [str(r["date"]) for r in yearly.orderBy("period").collect()] == ["2024-01-01", "2025-01-01"]
    daily = S.future_features(S.resample(sales_of(spark, [(1, "2024-02-28", 1)]), "D", by=["product_id"]), 2, "day")
    assert [(str(r["date"]), r["day_of_week"]) for r in daily.orderBy("period").collect()] == [("2024-02-29", 3), ("2024-03-01", 4)]


def test_stats_drop_a_partial_last_week(spark):
    full = [(1, f"2024-01-{d:02d}", 2) for d in range(1, 8)]
    sales = sales_of(spark, full + [(1, "2024-01-15", 100)])
    got = S.series_stats(sales, "week").first()
    # weeks of Jan 7 (14) and Jan 14 (0); the week of Jan 21 has one sale day
    assert got["weekly_avg"] == 7.0 and got["scope_count"] == 3 and got["scope_last_value"] == 100.0
    assert got["daily_avg"] == 114 / 8 and got["monthly_avg"] == 114.0
    lone = S.series_stats(sales_of(spark, [(1, "2024-01-15", 3)]), "day").first()
    assert lone["weekly_avg"] == 0.0 and lone["daily_std"] is None


def test_weekday_means(spark):
    got = S.dow_averages(S.daily_totals(sales_of(spark, [(1, "2024-01-01", 4), (1, "2024-01-08", 6)]))).collect()
    assert [(r["day_name"], r["average"]) for r in sorted(got, key=lambda r: r["day_of_week"])][:2] == [("Mon", 5.0), ("Tue", 0.0)]
    assert len(got) == 7


@pytest.mark.parametrize(
    "values, label",
    [
        ([1, 2], "Insufficient data to determine trend"),
        ([0, 0, 0], "Relatively flat / stable"),
        ([5, 5, 5], "Relatively flat / stable"),
        ([100, 102, 104], "Moderate upward trend (+6%)"),
        ([10, 20, 30], "Strong upward trend (+150% over recent period)"),
        ([104, 102, 100], "Moderate downward trend (-6%)"),
        ([30, 20, 10], "Strong downward trend (-150%)"),
    ],
)
def test_trend_labels(spark, values, label):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(values)], "product_id int, t int, quantity double")
    assert S.trend(df, order="t").first()["trend"] == label
    if label.startswith("Strong up"):
        assert S.trend(df, order="t", direction="reference").first()["trend"].startswith("Strong downward")


def test_kpis_with_ties(spark):
    data = [(1, "2024-01-01", 10, 2), (2, "2024-01-01", 1, 5), (1, "2024-01-01", 3, 2), (3, "2024-01-02", 4, 1), (9, "2024-01-02", 1, 1)]
    products = products_of(spark, [(1, "a", 1, 1, 1.0, 0.5), (2, "b", 1, 1, 1.0, 4.0)])
    got = K.business_kpis(sales_of(spark, data), products, ["order_id"]).first()
    # order: (day 1, product 1, orders 0 and 2), (day 1, product 2), (day 2, 3), (day 2, 9); split after 2 rows
    assert got["total_volume"] == 19 and got["total_revenue"] == 36.0 and got["total_cost"] == 13 * 0.5 + 4.0
    assert got["growth_pct"] == pytest.approx((10 - 26) / 26 * 100)
    assert got["growth_change"] == "High Velocity" and got["revenue"] == "$36" and got["revenue_change"] == "-61.54%"


def test_kpis_of_few_rows(spark):
    products = products_of(spark, [(1, "a", 1, 1, 1.0, 0.5)])
    one = K.business_kpis(sales_of(spark, [(1, "2024-01-01", 2, 3)]), products).first()
    assert one["growth"] == "0.0%" and one["growth_change"] == "Steady" and one["revenue_change"] == "+0.00%"
    free = K.business_kpis(sales_of(spark, [(1, "2024-01-01", 2, 0), (1, "2024-01-02", 2, 0)]), products).first()
    assert free["margin"] == "0.0%" and free["growth"] == "0.0%"
    assert K.business_kpis(sales_of(spark, [(1, "2024-01-01", 2, 0)]).limit(0), products).count() == 0


def test_kpi_split_agrees_with_a_full_sort(spark):
    import random

    random.seed(5)
    data = [(random.randint(1, 4), f"2024-01-{random.randint(1, 3):02d} 10:00:0{random.randint(0, 3)}", random.randint(1, 9), random.randint(1, 5)) for _ in range(101)]
    got = K.business_kpis(sales_of(spark, data), products_of(spark, [(1, "a", 1, 1, 1.0, 0.0)]), ["order_id"]).first()
    ordered = sorted((d, p, i, q * r) for i, (p, d, q, r) in enumerate(data))
    prev, recent = sum(x[3] for x in ordered[:50]), sum(x[3] for x in ordered[50:])
    assert got["growth_pct"] == pytest.approx((recent - prev) / prev * 100)


def test_ranking_and_inventory(spark):
    sales = sales_of(spark, [(1, "2024-01-01", 10, 2), (2, "2024-01-01", 20, 1), (7, "2024-01-01", 30, 1)])
    products = products_of(spark, [(1, "a", 50, 5, 1.0, 0.5), (2, "b", 50, 5, 1.0, 0.5), (3, "c", 5, 5, 1.0, 0.5)])
    top = K.revenue_breakdown(sales, products, 2).collect()
    assert [(r["name"], r["value"]) for r in top] == [("SKU #7", 30), ("a", 20)]
    categories = spark.createDataFrame([(2, "other")], "id int, name string")
    got = rows(K.inventory_status(products, categories, sales))
    assert got == [
        (1, "a", "Uncategorized", 50, 10.0, "Low"),
        (2, "b", "Uncategorized", 50, 20.0, "Monitor"),
        (3, "c", "Uncategorized", 5, 0.0, "High"),
        (7, "Unknown SKU #7", "Uncategorized", 0, 30.0, "High"),
    ]
    assert rows(K.inventory_status(products, None, sales, "UNKNOWN"), "id") == [(7,)]


def test_spikes(spark):
    products = products_of(spark, [(101, "a", 1, 10, 1.0, 1.0), (102, "b", 1, 40, 1.0, 1.0)])
    data = [(101, "2024-01-02", 120), (101, "2024-01-01", 31), (102, "2024-01-01", 120), (103, "2024-01-01", 61), (104, "2024-01-01", 60)]
    hits = A.anomaly_scan(sales_of(spark, data), products)
    assert rows(hits, "product_id", "quantity", "severity") == [(101, 31.0, "warning"), (103, 61.0, "warning")]
    big = A.anomaly_scan(sales_of(spark, [(101, "2024-01-02", 120)]), products).first()
    assert big["severity"] == "critical"
    assert big["message"] == "Anomaly: Product '101' sales velocity exceeds safety threshold (120.0 units)."
    ledger = A.emit_alerts(hits)
    assert ledger.columns == list(A.LEDGER_FIELDS) and ledger.select("alert_id").distinct().count() == 2
    ids = [r["alert_id"] for r in ledger.limit(1).collect()]
    assert A.resolve_alerts(ledger, ids).filter("is_resolved").count() == 1
    assert A.active_alerts(A.resolve_alerts(ledger, ids)).count() == 1
    assert A.active_alerts(A.resolve_alerts(ledger)).count() == 0
    assert A.active_alerts(ledger, "critical").count() == 0 and A.active_alerts(ledger, "all").count() == 2


def test_alert_without_time(spark):
    ledger = spark.createDataFrame([("1", None, None, None, None, False)], "alert_id string, severity string, event_type string, alert_ts timestamp, message string, is_resolved boolean")
    got = A.active_alerts(ledger).first()
    assert (got["severity"], got["type"], got["title"], got["time"]) == ("info", "system", "Unknown Alert", "Just now")


def test_reorder_rules(spark):
    products = products_of(
        spark,
        [(1, "idle", 5, 1, 2.0, 1.0), (2, "empty", 0, 60, 2.0, 1.0), (3, "short", 20, 1, 0.0, 1.0), (4, "low", 100, 200, 2.0, 1.0), (5, "fine", 100, 10, 2.0, 1.0), (6, "new", 9, 1, 2.0, 1.0)],
    )
    data = [(p, f"2024-01-{d:02d}", q) for p, q in ((1, 0), (2, 2), (3, 2), (4, 2), (5, 2)) for d in range(1, 15)] + [(6, "2024-01-01", 3)]
    got = {r["product_id"]: r for r in N.reorder_plan(products, sales_of(spark, data)).collect()}
    pick = {k: (r["status"], r["order_quantity"], r["reorder_in_days"], r["stock_out_in_days"], r["confidence"]) for k, r in got.items()}
    assert pick == {
        1: ("success", 0, 999, None, "low"),
        2: ("success", 120, 0, 0, "medium"),
        3: ("success", 42, 0, 10, "medium"),
        4: ("success", 300, 0, 50, "high"),
        5: ("success", 0, 36, 50, "high"),
        6: ("no_data", None, None, None, None),
    }
    assert got[3]["key_factors"] == ["Days of cover (10.0) <= lead time (14d)"]
    cover = {r["id"]: (r["days_of_cover"], r["margin_pct"]) for r in N.days_of_cover(products, N.daily_average(sales_of(spark, data))).collect()}
    assert cover[1] == (None, 50.0) and cover[3] == (10.0, 0.0)


def test_insight_facts(spark):
    products = products_of(spark, [(1, "a", 30, 5, 2.0, 1.0), (2, "b", 30, 5, 2.0, 1.0)])
    data = [(1, f"2024-01-{d:02d}", d) for d in range(1, 29)] + [(2, "2024-01-01", 3)]
    got = N.insight_facts(products, sales_of(spark, data), "week").collect()
    assert [r["product_id"] for r in got] == [1]
    assert got[0]["recent_values"] == [175.0, 126.0, 77.0, 28.0] and got[0]["trend_description"].startswith("Strong upward")


def test_split_bounds_reach_the_scan(spark, sf):
    """The later steps of the KPI split read the part of the table around the split only."""
    from tests.conftest import plan_text

    from demandloom.plans import views as V

    rows_ = V.sales(spark, sf).select("product_id", "ds", "quantity", K.revenue_column().alias("rev"))
    day = "1998-06-10"
    ds_type = rows_.schema["ds"].dataType
    kept = rows_.filter((F.col("ds") >= F.lit(day).cast(ds_type)) & (F.col("ds") < F.date_add(F.lit(day).cast("date"), 1).cast(ds_type)))
    assert "GreaterThanOrEqual(l_shipdate,1998-06-10T00:00)" in plan_text(kept)


def test_hot_product(spark):
    """A product with a third of all rows gives the same results as any other."""
    from demandloom.operators import orders as O

    n = 3000
    data = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise((F.col("id") % 50 + 2).cast("int")).alias("product_id"),
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, int(id % 20))").alias("ds"),
        (F.col("id") % 80).cast("double").alias("quantity"),
        F.lit(2.0).alias("price_at_sale"),
        F.col("id").alias("order_id"),
    )
    local = [r.asDict() for r in data.collect()]
    products = products_of(spark, [(p, str(p), 1, 20, 1.0, 0.5) for p in range(1, 53)])
    first = {}
    for r in sorted(local, key=lambda r: (r["ds"], r["order_id"])):
        if r["quantity"] > 60:
            first.setdefault(r["product_id"], r["quantity"])
    assert dict(rows(A.anomaly_scan(data, products, ["order_id"]), "product_id", "quantity")) == first
    fact = data.select("product_id", F.col("ds").alias("sale_date"), "quantity", F.col("quantity").alias("gross_sale"), "order_id")
    hot = [r for r in local if r["product_id"] == 1]
    got = O.daily_demand(fact).filter("product_id = 1").agg(F.sum("total_qty"), F.sum("order_count"), F.count("*")).first()
    assert tuple(got) == (sum(r["quantity"] for r in hot), len(hot), len({r["ds"] for r in hot}))
    ordered = sorted(local, key=lambda r: (r["ds"], r["product_id"], r["order_id"]))
    prev, recent = (sum(r["quantity"] for r in part) for part in (ordered[: n // 2], ordered[n // 2 :]))
    kpis = K.business_kpis(data, products, ["order_id"]).first()
    assert kpis["growth_pct"] == pytest.approx((recent - prev) / prev * 100)


@pytest.mark.parametrize("freq", ["D", "W", "M", "Q", "Y"])
def test_last_buckets_equal_the_tail_of_the_full_series(spark, freq):
    data = [(p, f"{2020 + (i * p) % 5}-{1 + (i * 7) % 12:02d}-{1 + (i * 3) % 28:02d}", i) for p in (1, 2, 3) for i in range(6)]
    sales = sales_of(spark, data + [(4, "2024-02-29", 1)])
    full = S.last_n(S.resample(sales, freq, by=["product_id"]), 4).drop("position")
    assert rows(S.resample(sales, freq, by=["product_id"], last=4)) == rows(full)


def test_moments_without_filling(spark):
    sales = sales_of(spark, [(1, "2024-01-01", 3), (1, "2024-03-10", 5), (1, "2024-07-04", 4), (2, "2024-01-01", 2)])
    full = S.resample(sales, "M", by=["product_id"])
    expected = rows(full.groupBy("product_id").agg(F.count("*"), F.avg("quantity"), F.round(F.stddev_samp("quantity"), 9), F.max_by("quantity", "period_end")))
    got = S.filled_moments(S.resample(sales, "M", by=["product_id"], fill=False), "M", ["product_id"])
    assert rows(got.withColumn("scope_std", F.round("scope_std", 9))) == expected


def test_kpis_of_a_hot_day(spark):
    """One product holds a third of all rows on one date; no step sorts its rows in one task."""
    n = 30_000
    day = F.when(F.col("id") % 3 == 0, F.lit("2024-01-02")).otherwise(F.concat(F.lit("2024-01-0"), (F.col("id") % 2 * 2 + 1).cast("string")))
    sales = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 1).otherwise(F.col("id") % 50 + 2).cast("int").alias("product_id"),
        day.cast("timestamp").alias("ds"),
        F.col("id").alias("order_id"),
        (F.col("id") % 7).cast("double").alias("quantity"),
        (F.col("id") % 11).cast("double").alias("price_at_sale"),
    )
    data = sorted((r["ds"], r["product_id"], r["order_id"], r["quantity"] * r["price_at_sale"]) for r in sales.collect())
    early, late = sum(r[3] for r in data[: n // 2]), sum(r[3] for r in data[n // 2 :])
    got = K.business_kpis(sales, spark.createDataFrame([(1, 1.0)], "id int, unit_cost double"), ["order_id"]).first()
    assert abs(got["growth_pct"] - (late - early) / early * 100) < 1e-9
    groups = sales.groupBy("order_id").agg(F.count("*").alias("n"), F.sum(F.lit(1.0)).alias("rev"))
    found = K._split_group(groups, ["order_id"], 12_345)
    assert (found["order_id"], found["rows_before"]) == (12_345, 12_345)
