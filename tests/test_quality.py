import datetime as dt

import pytest
from tests.conftest import rows
from pyspark.sql import functions as F

from demandloom.functions import is_empty, is_json_container, round_half_even, to_number
from demandloom.operators import profiling as P
from demandloom.operators import quality as Q


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def test_rounding_matches_binary_values(spark):
    for value, digits in ((0.125, 2), (0.025, 2), (2.675, 2), (0.375, 2), (1.005, 2), (5e-05, 4), (12345.5, 1), (-0.125, 2)):
        assert one(spark, round_half_even(F.lit(value), digits)) == round(value, digits)


def test_number_text(spark):
    cases = {"12": 12.0, " 1e3 ": 1000.0, ".5": 0.5, "1.": 1.0, "abc": None, "": None, "1d": None, "nan": None, "--1": None}
    for text, value in cases.items():
        assert one(spark, to_number(F.lit(text))) == value


def test_json_container(spark):
    cases = {'{"a": 1}': True, "[1]": True, "[]": True, "3": False, '"x"': False, "{'a': 1}": False, '{"a": 1} x': False, "[1], [2]": False}
    for text, value in cases.items():
        assert one(spark, is_json_container(F.lit(text))) is value, text


def test_is_empty(spark):
    df = spark.createDataFrame([(0.0, "0"), (float("nan"), " \t"), (None, None)], "x double, s string")
    assert [tuple(r) for r in df.select(is_empty(df, "x"), is_empty(df, "s")).collect()] == [(False, False), (True, True), (True, True)]


def frame(spark):
    return spark.createDataFrame(
        [
            (1.0, 1.5, "2024-01-01", '{"b": 1, "a": 2}', "x@y.org", None, True, dt.datetime(2024, 1, 2)),
            (2.0, float("nan"), "2024-02-29T10:00:00", '{"c": 1}', "a.b@c-d.io", None, False, None),
            (None, 2.5, "2024-03-01", "[1]", "x@y.org", None, None, dt.datetime(2023, 1, 1)),
        ],
        "whole double, frac double, day string, js string, mail string, nothing string, flag boolean, ts timestamp",
    )


def test_profile(spark):
    got = {r["name"]: r for r in P.profile(frame(spark)).collect()}
    kinds = {n: r["inferred_type"] for n, r in got.items()}
    assert kinds == {
        "whole": "integer", "frac": "float", "day": "datetime", "js": "json", "mail": "string",
        "nothing": "unknown", "flag": "boolean", "ts": "datetime",
    }
    assert got["frac"]["null_count"] == 1 and got["frac"]["null_percentage"] == 0.3333
    assert got["mail"]["unique_count"] == 2 and got["mail"]["detected_pattern"] == "email"
    assert got["js"]["is_nested"] and got["js"]["detected_pattern"] is None
    assert (got["whole"]["min_number"], got["whole"]["max_number"]) == (1.0, 2.0)
    assert got["ts"]["min_time"] == "2023-01-01T00:00:00" and got["day"]["max_time"] == "2024-03-01T00:00:00"
    sketch = {r["name"]: r["unique_count"] for r in P.profile(frame(spark), approximate_unique=True).collect()}
    assert sketch == {n: r["unique_count"] for n, r in got.items()}


def test_profile_of_variant_and_nested(spark):
    df = spark.sql("SELECT parse_json(v) AS v, array(1) AS l, struct(1 AS a) AS s FROM VALUES ('1'), ('\"x\"'), ('true'), ('2') AS t(v)")
    kinds = dict(rows(P.infer_types(df)))
    assert kinds == {"v": "mixed", "l": "list", "s": "json"}


def test_patterns_and_keys(spark):
    df = spark.createDataFrame(
        [("6FA459EA-EE8A-3CA4-894E-DB77E160355E", "2024-01-01 nonsense", "p"), ("6fa459ea-ee8a-3ca4-894e-db77e160355e", "2024-01-01", "q")],
        "u string, d string, t string",
    )
    assert rows(P.detect_pattern(df)) == [("d", "ISO-8601"), ("t", None), ("u", "UUID")]
    assert rows(P.nested_keys(frame(spark), "js")) == [("a",), ("b",), ("c",)]
    assert P.nested_keys(frame(spark), "mail").count() == 0
    assert {r["name"]: len(r["sample_values"]) for r in P.sample_values(frame(spark), ["mail", "whole"], 2).collect()} == {"mail": 2, "whole": 2}


def test_issues(spark):
    df = spark.createDataFrame([(1, None), (None, None)], "a int, b string")
    issues = rows(P.schema_issues(P.profile(df)))
    assert ("a", "warning", "Column has 50% null values.") in issues
    assert ("b", "critical", "Column has 100% null values — nearly empty.") in issues
    assert ("b", "warning", "Could not determine data type for this column.") in issues
    assert rows(P.schema_issues(P.profile(df.limit(0))))[0][1] == "critical"


def test_validate_and_drift(spark):
    before = P.profile(spark.createDataFrame([(1, "x", 2.5)], "a int, b string, c double"))
    after_df = spark.createDataFrame([("1", None, 1), ("z", 2.5, 1)], "a string, c double, d int")
    found = {(r["field"], r["severity"]) for r in P.validate_schema(after_df, before, strict=True).collect()}
    assert found == {("b", "critical"), ("d", "warning"), ("c", "warning")}
    assert ("d", "warning") not in {(r["field"], r["severity"]) for r in P.validate_schema(after_df, before).collect()}
    changes = P.schema_drift(before, P.profile(after_df))
    assert rows(changes) == [
        ("a", "type", "integer", "string", True),
        ("b", "removed", "string", None, True),
        ("c", "nullability", "false", "true", False),
        ("d", "added", None, "integer", False),
    ]
    assert P.drift_report(changes).first()["has_breaking_changes"]
    assert not P.drift_report(P.schema_drift(before, before)).first()["has_breaking_changes"]


def test_cast(spark):
    df = spark.createDataFrame([("1.0", "x", "2024-01-01", "true"), ("1.5", "2", "soon", "maybe")], "i string, f string, d string, b string")
    types = {"i": "integer", "f": "float", "d": "datetime", "b": "boolean", "absent": "integer"}
    out = Q.cast_to_profile(df, types)
    assert [tuple(r) for r in out.collect()] == [(1, None, dt.datetime(2024, 1, 1), True), (None, 2.0, None, None)]
    assert dict(Q.cast_to_profile(df, {"i": "json"}).dtypes)["i"] == "string"
    with pytest.raises(Exception, match="Failed to cast"):
        Q.cast_to_profile(df, types, errors="raise").collect()


def test_quality_check(spark):
    df = spark.createDataFrame([(1, None)] * 9 + [(1, "x")] * 3, "a int, b string")
    found = {(r["check"], r["severity"]) for r in Q.quality_check(df).collect()}
    assert found == {("null_ratio", "warning"), ("duplicates", "error")}
    assert Q.duplicate_rows(df).first()["duplicate_count"] == 10
    small = {r["check"] for r in Q.quality_check(df.limit(0)).collect()}
    assert small == {"row_count", "empty"}
    with pytest.raises(Q.QualityError, match="duplicate"):
        Q.require_quality(df)
    assert Q.quality_check(spark.range(20)).count() == 0


def test_gatekeeper(spark):
    df = spark.createDataFrame([("1", "5", "2024-01-01"), ("-1", "5", None), ("2", "x", "2024-01-01"), (None, None, None)], "product_id string, quantity string, date string")
    passed, failed = Q.gatekeeper(df, "sales", strict=False)
    assert rows(passed, "product_id", "quantity") == [(1, 5.0), (None, None)]
    assert rows(failed.select(F.explode("violations"))) == [("product_id:non_negative",), ("quantity:coerce",)]
    with pytest.raises(Q.QualityError):
        Q.gatekeeper(df, "sales", strict=True)
    no_id = df.drop("product_id").filter("quantity = '5'")
    assert Q.gatekeeper(no_id, "nonsense", strict=False)[0].count() == 2
    with pytest.raises(Q.QualityError, match="column_in_dataframe"):
        Q.gatekeeper(no_id, "sales")


def test_headers(spark):
    df = spark.createDataFrame([(1, 2)], ["  Sku Code ", "Name"])
    assert Q.normalize_headers(df).columns == ["sku_code", "name"]
    with pytest.raises(ValueError, match="price"):
        Q.require_columns(df, ["name", "price"])
