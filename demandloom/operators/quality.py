"""Casting, row rules and data-quality checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.functions import as_double, name_col, null_if_nan
from demandloom.functions.expr import digest, fixed_text

# The default limits of the quality check.
MIN_ROWS = 10
MAX_NULL_RATIO = 0.3
ERROR_NULL_RATIO = 0.9
ERROR_DUPLICATE_RATIO = 0.5

CASTABLE = ("integer", "float", "string", "boolean", "datetime", "date")


def _coerced(df: DataFrame, name: str, target: str) -> Column:
    """The column as ``target``; values that do not fit become NULL."""
    c = name_col(name)
    if target == "float":
        return as_double(df, name)
    if target == "integer":
        if isinstance(df.schema[name].dataType, T.IntegralType):
            return c.cast("bigint")
        number = as_double(df, name)
        return F.when(number == F.floor(number), number.try_cast("bigint"))
    if target == "boolean":
        return c.try_cast("boolean")
    if target in ("datetime", "date"):
        if isinstance(df.schema[name].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            out = c
        else:
            out = F.try_to_timestamp(c.cast("string"))
        return out.cast("date") if target == "date" else out
    return c.cast("string")


def cast_to_profile(df: DataFrame, types: Mapping[str, str] | DataFrame, errors: str = "coerce") -> DataFrame:
    """Cast columns to their profiled types.

    ``types`` is ``{column: inferred type}`` or a profile, of which only the names and types (one
    short row per column) are read. Nested, mixed and unknown columns are left alone. A value that
    does not fit becomes NULL, or raises when the job runs if ``errors="raise"``.
    """
    if isinstance(types, DataFrame):
        types = {r["name"]: r["inferred_type"] for r in types.select("name", "inferred_type").collect()}
    changed = {}
    for name, target in types.items():
        if name not in df.columns or target not in CASTABLE:
            continue
        new = _coerced(df, name, target)
        if errors == "raise":
            lost = null_if_nan(df, name).isNotNull() & new.isNull()
            message = F.concat(F.lit(f"Failed to cast '{name}' to {target}: "), name_col(name).cast("string"))
            new = F.when(lost, F.raise_error(message)).otherwise(new)
        changed[name] = new
    return df.withColumns(changed) if changed else df


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: total rows and how many repeat an earlier one. Only digests are shuffled."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return df.agg(F.count_distinct(digest(df)).alias("kept")).select(
        total.alias("record_count"), (total - F.col("kept")).alias("duplicate_count")
    )


def quality_check(df: DataFrame, min_rows: int = MIN_ROWS, max_null_ratio: float = MAX_NULL_RATIO) -> DataFrame:
    """Rows (check, column, severity, value, message) for every failed check; none when all is well."""
    counts = df.agg(
        F.count(F.lit(1)).alias("n"), *[F.count(null_if_nan(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    )
    n = F.col("n")

    def finding(check, column, severity, value, message):
        return F.struct(
            F.lit(check).alias("check"),
            F.lit(column).cast("string").alias("column"),
            severity.alias("severity"),
            value.cast("double").alias("value"),
            message.alias("message"),
        )

    def percent(c):
        return F.concat(fixed_text(c * 100, 1), F.lit("%"))

    few = F.when(
        n < min_rows,
        finding(
            "row_count",
            None,
            F.lit("error"),
            n,
            F.concat(F.lit("Row count ("), n, F.lit(f") is below minimum ({min_rows}).")),
        ),
    )
    empty = F.when(
        n == 0, finding("empty", None, F.lit("error"), n, F.lit("DataFrame is empty after transformation."))
    )
    nulls = []
    for i, c in enumerate(df.columns):
        ratio = F.try_divide(n - F.col(f"c{i}"), n)
        nulls.append(
            F.when(
                ratio > max_null_ratio,
                finding(
                    "null_ratio",
                    c,
                    F.when(ratio > ERROR_NULL_RATIO, "error").otherwise("warning"),
                    ratio,
                    F.concat(
                        F.lit(f"Column '{c}' has "),
                        percent(ratio),
                        F.lit(f" nulls (threshold: {max_null_ratio * 100:.1f}%)."),
                    ),
                ),
            )
        )
    basic = counts.select(F.inline(F.array_compact(F.array(few, empty, *nulls))))
    ratio = F.try_divide(F.col("duplicate_count"), F.col("record_count"))
    duplicates = (
        duplicate_rows(df)
        .filter("duplicate_count > 0")
        .select(
            finding(
                "duplicates",
                None,
                F.when(ratio > ERROR_DUPLICATE_RATIO, "error").otherwise("warning"),
                F.col("duplicate_count"),
                F.concat(F.col("duplicate_count"), F.lit(" duplicate rows ("), percent(ratio), F.lit(" of data).")),
            ).alias("f")
        )
        .select("f.*")
    )
    return basic.unionByName(duplicates)


class QualityError(ValueError):
    """A check that must hold did not."""


def require_quality(df: DataFrame, **limits) -> DataFrame:
    """The same frame, or QualityError when a check has severity error."""
    errors = [r["message"] for r in quality_check(df, **limits).filter("severity = 'error'").collect()]
    if errors:
        raise QualityError(f"Data validation failed with {len(errors)} error(s): " + " | ".join(errors))
    return df


@dataclass(frozen=True)
class Rule:
    """What one field of a rule set must satisfy."""

    kind: str
    non_negative: bool = False
    nullable: bool = False
    required: bool = True


# The business rules per kind of table.
RULESETS: dict[str, dict[str, Rule]] = {
    "sales": {
        "product_id": Rule("integer", non_negative=True, nullable=True),
        "sales": Rule("float", non_negative=True, nullable=True, required=False),
        "quantity": Rule("float", non_negative=True, nullable=True, required=False),
        "price": Rule("float", non_negative=True, nullable=True, required=False),
        "sell_date": Rule("datetime", nullable=True, required=False),
        "date": Rule("datetime", nullable=True, required=False),
    },
    "orders": {
        "order_id": Rule("string"),
        "order_date": Rule("datetime"),
        "customer_id": Rule("string", nullable=True),
    },
    "order_items": {
        "order_id": Rule("string"),
        "product_id": Rule("string"),
        "quantity": Rule("float", non_negative=True),
        "unit_price": Rule("float", non_negative=True),
        "gross_sale": Rule("float"),
        "sale_date": Rule("datetime"),
    },
}


def ruleset(name: str) -> dict[str, Rule]:
    """The rule set of that name; an unknown name means sales."""
    return RULESETS.get(name.lower(), RULESETS["sales"])


def _checked(df: DataFrame, rules: str) -> tuple[DataFrame, list[tuple[str, Column]], list[Column]]:
    """(frame with the coerced values as extra columns, labelled failure conditions, output columns).

    Coerced first, as columns of their own, so that each value is parsed once.
    """
    held = {name: rule for name, rule in ruleset(rules).items() if name in df.columns}
    parsed = df.withColumns({f"_new_{name}": _coerced(df, name, rule.kind) for name, rule in held.items()})
    checks = []
    for name, rule in held.items():
        raw, new = null_if_nan(df, name), name_col(f"_new_{name}")
        checks.append((f"{name}:coerce", raw.isNotNull() & new.isNull()))
        if rule.non_negative:
            checks.append((f"{name}:non_negative", F.coalesce(new < 0, F.lit(False))))
        if not rule.nullable:
            checks.append((f"{name}:not_null", raw.isNull()))
    kept = [name_col(f"_new_{c}").alias(c) if c in held else name_col(c) for c in df.columns]
    return parsed, checks, kept


def _violations(checks: list[tuple[str, Column]]) -> Column:
    labels = [F.when(failed, F.lit(label)) for label, failed in checks]
    array = F.array_compact(F.array(*labels)) if labels else F.array().cast("array<string>")
    return array.alias("violations")


def with_violations(df: DataFrame, rules: str = "sales") -> DataFrame:
    """Coerced columns plus ``violations``, an array of ``column:check`` texts."""
    parsed, checks, kept = _checked(df, rules)
    return parsed.select(*kept, _violations(checks))


def missing_required(df: DataFrame, rules: str = "sales") -> list[str]:
    return [c for c, rule in ruleset(rules).items() if rule.required and c not in df.columns]


def gatekeeper(df: DataFrame, rules: str = "sales", strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows that pass, rows that fail with their violations), both coerced.

    Strict: any violation, or a missing required column, raises instead. Otherwise a missing column
    concerns no row and drops none.
    """
    if strict:
        absent = [(c, "column_in_dataframe", 1) for c in missing_required(df, rules)]
        found = absent + [tuple(r) for r in violation_report(df, rules).collect()]
        if found:
            raise QualityError(f"Rules '{rules}' violated: {found}")
    parsed, checks, kept = _checked(df, rules)
    bad = reduce(lambda a, b: a | b, [failed for _, failed in checks], F.lit(False))
    return parsed.filter(~bad).select(*kept), parsed.filter(bad).select(*kept, _violations(checks))


def violation_report(df: DataFrame, rules: str = "sales") -> DataFrame:
    """Rows (column, check, count)."""
    parts = F.split("violation", ":")
    return (
        with_violations(df, rules)
        .select(F.explode("violations").alias("violation"))
        .groupBy(parts[0].alias("column"), parts[1].alias("check"))
        .agg(F.count(F.lit(1)).alias("count"))
    )


def normalize_headers(df: DataFrame) -> DataFrame:
    """Trimmed, lower-case names with underscores for blanks."""
    return df.toDF(*[c.strip().lower().replace(" ", "_") for c in df.columns])


def require_columns(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """The same frame, or ValueError naming the columns it lacks."""
    actual = {c.lower().strip() for c in df.columns}
    missing = [c for c in required if c.lower() not in actual]
    if missing:
        raise ValueError(f"Missing required columns: {', '.join(missing)}")
    return df
