"""Schemas of the analytic tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Column names and types of each table.
TABLES = {
    "sales": "product_id int, ds timestamp, transaction_id string, quantity decimal(18,4), "
    "price_at_sale decimal(18,2), customer_id string, region_id int, channel string",
    "products": "id int, sku_code string, name string, category_id int, base_price decimal(12,2), "
    "unit_cost decimal(12,2), weight decimal(10,3), dimensions string, current_stock int, "
    "safety_stock int, status string, created_at timestamp, updated_at timestamp",
    "categories": "id int, name string, parent_id int",
    "customers": "id string, name string, email string, region_id int, segment_id int, ltv decimal(15,2)",
    "orders_backlog": "order_id string, source_id int, customer_id string, order_date timestamp, "
    "status string, total_amount decimal(18,2), raw_items string, extracted_at timestamp",
    "fact_sales": "order_id string, source_id int, product_id string, quantity decimal(18,4), "
    "unit_price decimal(18,2), discount decimal(18,2), gross_sale decimal(18,2), "
    "net_sale decimal(18,2), sale_date timestamp",
    "dim_customers": "customer_id string, name string, email string, segment string, region string",
    "agg_daily_demand": "product_id string, sale_date date, total_qty decimal(18,4), "
    "total_revenue decimal(18,2), order_count bigint",
    "sync_watermarks": "source_id int, last_synced_at timestamp, rows_synced bigint, "
    "sync_duration_s double, updated_at timestamp",
    "data_sources": "id int, name string, source_type string, conn_uri string, status string, "
    "source_table string, column_mapping string, sync_interval_hours int, last_synced timestamp",
    "inference_logs": "product_id int, model_name string, model_version string, predicted_value double, "
    "prediction_ts timestamp, features_json string, actual_value double, status string, "
    "drift_detected boolean",
    "metric_cache": "metric_name string, bucket_start timestamp, metric_value double, event_count bigint",
    "system_alerts": "alert_id string, severity string, event_type string, alert_ts timestamp, "
    "message string, is_resolved boolean, product_id int",
    "insights": "id int, title string, category string, impact string, visual_schema string, created_at timestamp",
    "reports": "name string, report_type string, file_path string, file_size_kb bigint, created_at timestamp",
}


def table_schema(name: str) -> T.StructType:
    return T.StructType.fromDDL(TABLES[name])
