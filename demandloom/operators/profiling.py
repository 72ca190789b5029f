"""Schema profiling: types, nulls, cardinality, patterns, nested keys, drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandloom.functions import is_json_container, name_col, null_if_nan, round_half_even, to_number
from demandloom.functions.expr import exact_text, fixed_text, is_floating

# Text patterns in the order they are tested, and the shares that decide a type.
PATTERNS = {
    "ISO-8601": r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}(:\d{2})?)?",
    "UUID": r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    "email": r"^[\w.+-]+@[\w-]+\.[\w.]+$",
}
PATTERN_SHARE = 0.8
JSON_SHARE = 0.5
DOMINANT_SHARE = 0.8
NULL_WARNING = 0.5
NULL_CRITICAL = 0.9

NESTED_TYPES = (T.StructType, T.MapType, T.ArrayType)
PROFILE_FIELDS = (
    "position",
    "name",
    "inferred_type",
    "original_dtype",
    "record_count",
    "nullable",
    "null_count",
    "null_percentage",
    "unique_count",
    "cardinality_ratio",
    "min_number",
    "max_number",
    "min_time",
    "max_time",
    "is_nested",
    "detected_pattern",
)
ISO_FORMAT = "yyyy-MM-dd'T'HH:mm:ss"


def _share(hit: Column, value: Column) -> Column:
    """Share of the non-null values that satisfy ``hit``; NULL without values."""
    return F.avg(F.when(value.isNotNull(), F.coalesce(hit, F.lit(False)).cast("double")))


def _pattern(shares: dict[str, Column]) -> Column:
    out = F.lit(None).cast("string")
    for label in reversed(list(PATTERNS)):
        out = F.when(shares[label] > PATTERN_SHARE, F.lit(label)).otherwise(out)
    return out


def _variant_kind(c: Column) -> Column:
    """Rough kind of a VARIANT value."""
    schema = F.schema_of_variant(c)
    return (
        F.when(schema.startswith("OBJECT"), "json")
        .when(schema.startswith("ARRAY"), "list")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema == "BIGINT", "integer")
        .when(schema.startswith("DECIMAL") | schema.isin("DOUBLE", "FLOAT"), "float")
        .when(schema == "STRING", "string")
        .when(schema.startswith("TIMESTAMP") | (schema == "DATE"), "datetime")
    )


def _text_kind(c: Column) -> Column:
    """Kind a text value would have had before it was written as text."""
    return (
        F.when(c.isNull(), None)
        .when(is_json_container(c), F.when(c.rlike(r"^\s*\{"), "json").otherwise("list"))
        .when(F.lower(c).isin("true", "false"), "boolean")
        .when(c.rlike(r"^\s*[+-]?\d+\s*$"), "integer")
        .when(to_number(c).isNotNull(), "float")
        .otherwise("string")
    )


KINDS = ("json", "list", "boolean", "integer", "float", "string", "datetime")


class _FieldPlan:
    """The aggregates one column adds to the single profiling pass, and how they are read back."""

    def __init__(self, df: DataFrame, position: int, field: T.StructField, text_kinds: bool):
        self.position, self.field, self.prefix = position, field, f"f{position}_"
        self.value = null_if_nan(df, field.name)
        self.dtype = field.dataType
        self.aggs: dict[str, Column] = {"n": F.count(self.value)}
        v, d = self.value, self.dtype
        if isinstance(d, T.NumericType):
            self.aggs["lo"], self.aggs["hi"] = F.min(v).cast("double"), F.max(v).cast("double")
        if is_floating(d) or isinstance(d, T.DecimalType):
            self.aggs["whole"] = F.bool_and(v == F.floor(v))
        if isinstance(d, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            self.aggs["t_lo"], self.aggs["t_hi"] = F.min(v), F.max(v)
        if isinstance(d, T.StringType):
            for label, regex in PATTERNS.items():
                self.aggs[label] = _share(v.rlike(regex), v)
            self.aggs["json"] = _share(is_json_container(v), v)
            parsed = F.when(v.rlike(PATTERNS["ISO-8601"]), F.try_to_timestamp(v))
            self.aggs["t_lo"], self.aggs["t_hi"] = F.min(parsed), F.max(parsed)
        self.kinds = isinstance(d, T.VariantType) or (text_kinds and isinstance(d, T.StringType))
        if self.kinds:
            kind = _text_kind(v) if isinstance(d, T.StringType) else _variant_kind(v)
            for k in KINDS:
                self.aggs[f"kind_{k}"] = _share(kind == k, v)

    def stat(self, key: str) -> Column:
        return name_col(self.prefix + key)

    def aggregates(self) -> list[Column]:
        return [expr.alias(self.prefix + key) for key, expr in self.aggs.items()]

    def inferred(self) -> Column:
        d = self.dtype
        if self.kinds:
            return self._kind_type()
        if isinstance(d, T.BooleanType):
            return F.lit("boolean")
        if isinstance(d, T.IntegralType):
            return F.lit("integer")
        if isinstance(d, T.NumericType):
            return F.when(self.stat("whole"), "integer").otherwise("float")
        if isinstance(d, (T.TimestampType, T.TimestampNTZType)):
            return F.lit("datetime")
        if isinstance(d, T.DateType):
            return F.lit("date")
        if isinstance(d, (T.StructType, T.MapType)):
            return F.lit("json")
        if isinstance(d, T.ArrayType):
            return F.lit("list")
        if isinstance(d, T.StringType):
            return self._text_type()
        return F.lit("unknown")

    def _text_type(self) -> Column:
        return (
            F.when(self.stat("n") == 0, "unknown")
            .when(self.stat("json") > JSON_SHARE, "json")
            .when(self.stat("ISO-8601") > PATTERN_SHARE, "datetime")
            .otherwise("string")
        )

    def _kind_type(self) -> Column:
        shares = [self.stat(f"kind_{k}") for k in KINDS]
        top = F.greatest(*shares)
        present = sum((F.coalesce(s, F.lit(0.0)) > 0).cast("int") for s in shares)
        chosen = F.coalesce(*[F.when(s == top, F.lit(k)) for k, s in zip(KINDS, shares)])
        if isinstance(self.dtype, T.StringType):
            chosen = F.when(chosen == "string", self._text_type()).otherwise(chosen)
        return (
            F.when(self.stat("n") == 0, "unknown")
            .when((top < DOMINANT_SHARE) & (present > 1), "mixed")
            .otherwise(chosen)
        )

    def row(self) -> Column:
        """The column's profile as a struct, from the one-row aggregate."""
        total, n = F.col("record_count"), self.stat("n")
        inferred = self.inferred()
        numeric = "lo" in self.aggs
        timed = "t_lo" in self.aggs
        text = isinstance(self.dtype, T.StringType)

        def time_text(key):
            if not timed:
                return F.lit(None).cast("string")
            shown = F.date_format(self.stat(key), ISO_FORMAT)
            return F.when(inferred == "datetime", shown) if text else shown

        pattern = _pattern({k: self.stat(k) for k in PATTERNS}) if text else F.lit(None).cast("string")
        nested = (
            F.lit(isinstance(self.dtype, NESTED_TYPES))
            if not text
            else F.coalesce(self.stat("json") > JSON_SHARE, F.lit(False))
        )
        missing = total - n
        values = {
            "position": F.lit(self.position),
            "name": F.lit(self.field.name),
            "inferred_type": inferred,
            "original_dtype": F.lit(self.dtype.simpleString()),
            "record_count": total,
            "nullable": missing > 0,
            "null_count": missing,
            "null_percentage": F.coalesce(round_half_even(F.try_divide(missing, total), 4), F.lit(0.0)),
            "min_number": self.stat("lo") if numeric else F.lit(None).cast("double"),
            "max_number": self.stat("hi") if numeric else F.lit(None).cast("double"),
            "min_time": time_text("t_lo"),
            "max_time": time_text("t_hi"),
            "is_nested": nested,
            "detected_pattern": F.when(inferred == "string", pattern),
        }
        return F.struct(*[v.alias(k) for k, v in values.items()])


def profile(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    approximate_unique: bool = False,
    text_kinds: bool = False,
) -> DataFrame:
    """One row per column: type, nulls, distinct values, range, pattern.

    Everything but the distinct counts comes from one pass that shuffles one row per task. The exact
    distinct counts take a second pass; ``approximate_unique`` uses a sketch in the first instead.
    ``text_kinds`` also reads text values as the kind they look like, so a column of unlike values
    is called mixed. ``VARIANT`` columns always are.
    """
    names = list(columns or df.columns)
    plans = [_FieldPlan(df, i, df.schema[c], text_kinds) for i, c in enumerate(names)]
    aggs = [F.count(F.lit(1)).alias("record_count")]
    for p in plans:
        aggs += p.aggregates()
        if approximate_unique:
            aggs.append(F.approx_count_distinct(_comparable(p.value, p.dtype)).alias(p.prefix + "unique"))
    one_row = df.agg(*aggs)
    structs = []
    for p in plans:
        s = p.row()
        if approximate_unique:
            s = s.withField("unique_count", p.stat("unique"))
        structs.append(s)
    rows = one_row.select(F.inline(F.array(*structs)))
    if not approximate_unique:
        rows = rows.join(unique_counts(df, names), on="name", how="left").withColumn(
            "unique_count", F.coalesce("unique_count", F.lit(0).cast("bigint"))
        )
    ratio = F.coalesce(
        round_half_even(F.try_divide(F.col("unique_count"), F.col("record_count")), 4), F.lit(0.0)
    )
    return rows.withColumn("cardinality_ratio", ratio).select(*PROFILE_FIELDS)


def _comparable(value: Column, dtype: T.DataType) -> Column:
    """A short text that is equal exactly for equal values."""
    if isinstance(dtype, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
        return F.when(value.isNotNull(), F.md5(exact_text(value, dtype)))
    text = value.cast("string")
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return F.when(F.length(text) > 32, F.concat(F.lit("#"), F.md5(text))).otherwise(text)
    return text


def _wire_form(value: Column, dtype: T.DataType) -> tuple[str, Column]:
    """(kind, value) as shuffled for the distinct counts: 8-byte numbers where the type allows."""
    if isinstance(dtype, (T.IntegralType, T.BooleanType)):
        return "whole", value.cast("bigint")
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return "whole", F.unix_micros(value.cast("timestamp"))
    if isinstance(dtype, T.DateType):
        return "whole", F.unix_date(value).cast("bigint")
    if is_floating(dtype):
        return "real", value.cast("double")
    return "text", _comparable(value, dtype)


def unique_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exact distinct non-null values per column.

    The values are laid out as (column, value), one frame per kind of value, and combined per task
    before the shuffle, so a value held by most rows travels once per task. Long text is replaced by
    its 128-bit digest.
    """
    cells: dict[str, list[Column]] = {}
    for c in columns:
        kind, value = _wire_form(null_if_nan(df, c), df.schema[c].dataType)
        cells.setdefault(kind, []).append(F.struct(F.lit(c).alias("name"), value.alias("value")))
    counts = None
    for kind in cells.values():
        long = df.select(F.inline(F.array(*kind))).filter(F.col("value").isNotNull())
        part = long.groupBy("name").agg(F.count_distinct("value").alias("unique_count"))
        counts = part if counts is None else counts.unionAll(part)
    return counts


def infer_types(df: DataFrame, columns: Sequence[str] | None = None, text_kinds: bool = False) -> DataFrame:
    """Name and inferred type per column, in one pass."""
    return profile(df, columns, approximate_unique=True, text_kinds=text_kinds).select("name", "inferred_type")


def detect_pattern(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """The first text pattern that more than 80 % of a column's values match."""
    names = list(columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)])
    aggs, rows = [], []
    for i, c in enumerate(names):
        value = name_col(c)
        labels = {label: f"p{i}_{label}" for label in PATTERNS}
        aggs += [_share(value.rlike(PATTERNS[label]), value).alias(a) for label, a in labels.items()]
        found = _pattern({label: name_col(a) for label, a in labels.items()})
        rows.append(F.struct(F.lit(c).alias("name"), found.alias("detected_pattern")))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def sample_values(df: DataFrame, columns: Sequence[str] | None = None, n: int = 5) -> DataFrame:
    """Up to ``n`` non-null values per column, as text."""
    parts = []
    for c in columns or df.columns:
        dtype = df.schema[c].dataType
        value = F.to_json(name_col(c)) if isinstance(dtype, NESTED_TYPES) else name_col(c).cast("string")
        few = df.select(value.alias("value")).filter(F.col("value").isNotNull()).limit(n)
        parts.append(few.select(F.lit(c).alias("name"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out.groupBy("name").agg(F.collect_list("value").alias("sample_values"))


def nested_keys(df: DataFrame, column: str) -> DataFrame:
    """Object keys found in a nested column, one row each, when over half its values are nested."""
    dtype = df.schema[column].dataType
    value = name_col(column)
    if isinstance(dtype, T.StructType):
        return df.sparkSession.createDataFrame([(k,) for k in sorted(dtype.names)], "key string")
    if isinstance(dtype, T.MapType):
        return df.select(F.explode(F.map_keys(value)).alias("key")).distinct()
    if not isinstance(dtype, T.StringType):
        return df.sparkSession.createDataFrame([], "key string")
    nested = df.agg(_share(is_json_container(value), value).alias("share")).scalar()
    objects = df.filter((nested > JSON_SHARE) & value.rlike(r"^\s*\{"))
    return objects.select(F.explode(F.json_object_keys(value)).alias("key")).distinct()


def schema_issues(profile_df: DataFrame) -> DataFrame:
    """Rows (field, severity, message) for columns with many nulls or no clear type."""
    share = F.col("null_count") / F.col("record_count")
    percent = fixed_text(F.try_divide(F.col("null_count"), F.col("record_count")) * 100, 0)
    nulls = F.when(
        share >= NULL_CRITICAL,
        F.struct(
            F.lit("critical").alias("severity"),
            F.concat(F.lit("Column has "), percent, F.lit("% null values — nearly empty.")).alias("message"),
        ),
    ).when(
        share >= NULL_WARNING,
        F.struct(
            F.lit("warning").alias("severity"),
            F.concat(F.lit("Column has "), percent, F.lit("% null values.")).alias("message"),
        ),
    )
    kind = F.when(
        F.col("inferred_type") == "mixed",
        F.struct(F.lit("warning").alias("severity"), F.lit("Column contains mixed data types.").alias("message")),
    ).when(
        F.col("inferred_type") == "unknown",
        F.struct(
            F.lit("warning").alias("severity"),
            F.lit("Could not determine data type for this column.").alias("message"),
        ),
    )
    per_field = (
        profile_df.filter("record_count > 0")
        .select(F.col("name").alias("field"), F.explode(F.array_compact(F.array(nulls, kind))).alias("issue"))
        .select("field", "issue.severity", "issue.message")
    )
    empty = (
        profile_df.agg(F.max("record_count").alias("n"))
        .filter(F.coalesce("n", F.lit(0)) == 0)
        .select(
            F.lit(None).cast("string").alias("field"),
            F.lit("critical").alias("severity"),
            F.lit("DataFrame is empty — no data to infer schema from.").alias("message"),
        )
    )
    return per_field.unionByName(empty)


def save_profile(profile_df: DataFrame, path: str, source_name: str) -> None:
    """Append a snapshot of the profile to the history table."""
    stamped = profile_df.select(
        F.lit(source_name).alias("source_name"), F.current_timestamp().alias("inferred_at"), "*"
    )
    stamped.write.mode("append").partitionBy("source_name").parquet(path)


def latest_profile(spark: SparkSession, path: str, source_name: str) -> DataFrame:
    """The newest snapshot of a source, one row per column, as a frame of its own.

    It does not keep reading the history: Spark takes two scans of one folder for the same data even
    when files were added in between, so an old and a new snapshot could not meet in one plan.
    """
    history = spark.read.parquet(path).filter(F.col("source_name") == source_name)
    newest = history.agg(F.max("inferred_at").alias("m")).scalar()
    return spark.createDataFrame(history.filter(F.col("inferred_at") == newest).collect(), history.schema)


def validate_schema(df: DataFrame, expected: DataFrame, strict: bool = False) -> DataFrame:
    """Rows (field, severity, message): what ``df`` lacks or has beyond an expected profile."""
    counts = [F.count(null_if_nan(df, c)).alias(f"c{i}") for i, c in enumerate(df.columns)]
    found = df.agg(F.count(F.lit(1)).alias("total"), *counts).select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(c).alias("name"), (F.col("total") - F.col(f"c{i}")).alias("nulls"))
                    for i, c in enumerate(df.columns)
                ]
            )
        )
    )
    both = expected.select("name", F.col("nullable").alias("may_be_null")).join(found, on="name", how="full_outer")
    name = F.col("name")
    missing = F.col("nulls").isNull()
    extra = F.col("may_be_null").isNull() & ~missing
    broken = ~F.col("may_be_null") & (F.col("nulls") > 0)
    checked = both.select(
        name.alias("field"),
        F.when(missing, "critical").when(extra | broken, "warning").alias("severity"),
        F.when(missing, F.concat(F.lit("Expected column '"), name, F.lit("' is missing from the DataFrame.")))
        .when(extra, F.concat(F.lit("Unexpected column '"), name, F.lit("' found (not in schema).")))
        .otherwise(
            F.concat(F.lit("Column was not nullable in schema but has "), F.col("nulls"), F.lit(" null value(s)."))
        )
        .alias("message"),
        extra.alias("extra"),
    ).filter(F.col("severity").isNotNull())
    if not strict:
        checked = checked.filter(~F.col("extra"))
    return checked.drop("extra")


def schema_drift(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Changes between two profiles, one row each.

    ``change`` is added, removed, type or nullability; removed fields and type changes are breaking.
    """
    p = previous.select("name", F.col("inferred_type").alias("p_type"), F.col("nullable").alias("p_null"))
    c = current.select("name", F.col("inferred_type").alias("c_type"), F.col("nullable").alias("c_null"))
    both = p.join(c, on="name", how="full_outer")

    def entry(change, before, after, breaking):
        return F.struct(
            F.lit(change).alias("change"),
            before.cast("string").alias("previous"),
            after.cast("string").alias("current"),
            F.lit(breaking).alias("breaking"),
        )

    gone, new = F.col("c_type").isNull(), F.col("p_type").isNull()
    changes = F.array(
        F.when(gone, entry("removed", F.col("p_type"), F.lit(None), True)),
        F.when(new, entry("added", F.lit(None), F.col("c_type"), False)),
        F.when(F.col("p_type") != F.col("c_type"), entry("type", F.col("p_type"), F.col("c_type"), True)),
        F.when(F.col("p_null") != F.col("c_null"), entry("nullability", F.col("p_null"), F.col("c_null"), False)),
    )
    return both.select(F.col("name").alias("field"), F.explode(F.array_compact(changes)).alias("e")).select(
        "field", "e.*"
    )


def drift_report(changes: DataFrame) -> DataFrame:
    """One row: counts per kind of change and whether any is breaking."""
    return changes.agg(
        F.count_if(F.col("change") == "added").alias("added_fields"),
        F.count_if(F.col("change") == "removed").alias("removed_fields"),
        F.count_if(F.col("change") == "type").alias("type_changes"),
        F.count_if(F.col("change") == "nullability").alias("nullability_changes"),
        F.coalesce(F.bool_or("breaking"), F.lit(False)).alias("has_breaking_changes"),
    )
