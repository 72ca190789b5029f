"""Incremental loads with a high-water mark per source."""

from __future__ import annotations

import time
from collections.abc import Iterator, Mapping, Sequence
from contextlib import ExitStack, contextmanager
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandloom.functions import name_col
from demandloom.operators.maintenance import upsert
from demandloom.operators.demand import MONTH, _short as short_id, with_month
from demandloom.operators.orders import load_kept, load_orders, message_id, undated_orders
from demandloom.session import materialize, parts_for
from demandloom.sources import ledger

MARK_SCHEMA = "source_id int, last_synced_at timestamp, rows_synced bigint, sync_duration_s double, updated_at timestamp"
DEFAULT_INTERVAL_HOURS = 6


def high_water_mark(marks: DataFrame, source_id: int) -> str | None:
    """The newest event time already loaded, None when the source was never synced.

    As text: a Python datetime would be moved by any difference between the zones of Python and of
    the session.
    """
    row = marks.filter(F.col("source_id") == source_id).agg(F.max("last_synced_at").cast("string").alias("m")).first()
    return row["m"]


def since(df: DataFrame, mark: str | None, date_col: str, lookback_days: int | None = None) -> DataFrame:
    """Dated rows, from ``lookback_days`` before the mark on. The bound is a literal, so it reaches the scan.

    None looks back over everything.
    """
    dated = df.filter(name_col(date_col).isNotNull())
    if mark is None or lookback_days is None:
        return dated
    oldest = F.lit(mark).cast("timestamp") - F.expr(f"INTERVAL {int(lookback_days)} DAYS")
    return dated.filter(name_col(date_col) >= oldest.cast(df.schema[date_col].dataType))


@contextmanager
def not_loaded(
    df: DataFrame, out_dir: str, table: str, source_id: int, mapping: Mapping[str, str], months: Sequence[int] | None = None
) -> Iterator[DataFrame | None]:
    """Rows whose message is not in a loaded table yet, for as long as the block runs; None if there are none.

    Only digests are shuffled, as bytes and some to a task. Where all rows are new, or none, that is
    all there is to do; else the rows are joined with the digests that are new.

    ``months`` are those of the rows' dates, if they have some: other months of the table, which are
    folders, are not read. A message's digest holds its date, so no other month can have it.
    """
    known = ledger.read(df.sparkSession, out_dir, table)
    if known is not None and months is not None:
        known = known.filter(F.col(MONTH).isin(list(months)))
    given, there = df.count(), 0 if known is None else known.count()  # by the footers, or one column
    if not given or not there:
        yield df if given else None
        return
    message, parts = short_id(message_id(df, mapping)), parts_for(max(given, there))
    loaded = known.filter(F.col("source_id") == source_id).select(short_id(F.col("message_id")).alias("_message"))
    both = [d.repartition(parts, "_message") for d in (df.select(message.alias("_message")), loaded)]
    with materialize(both[0].join(both[1], "_message", "left_anti"), "new-ids") as new:
        rows = new.count()
        if rows == given:
            yield df
        elif not rows:
            yield None
        else:
            found = df.withColumn("_message", message).join(new.distinct(), "_message", "left_semi")
            yield found.select(*[name_col(c) for c in df.columns])


def _wanted(df: DataFrame, mark: str | None, date_col: str, lookback_days: int | None) -> DataFrame:
    """What ``since`` gives, and the rows without a date."""
    if mark is None or lookback_days is None:
        return df
    return since(df, mark, date_col, lookback_days).unionByName(df.filter(name_col(date_col).isNull()))


def advance_marks(
    marks: DataFrame, source_id: int, mark: str, rows_synced: int, duration_s: float = 0.0
) -> DataFrame:
    """The control table with this source's mark moved to ``mark``, the newest event time loaded.

    The event time, not the clock, is stored: a row that arrives late but is newer than everything
    loaded so far is still picked up.
    """
    spark = marks.sparkSession
    new = spark.createDataFrame([(source_id, rows_synced, float(duration_s))], "source_id int, rows_synced bigint, sync_duration_s double")
    return upsert(
        marks,
        new.withColumns(
            {"last_synced_at": F.lit(mark).cast("timestamp"), "updated_at": F.current_timestamp()}
        ),
        "source_id",
    )


def incremental_sync(
    source: DataFrame,
    marks: DataFrame,
    source_id: int,
    out_dir: str,
    date_col: str = "order_date",
    mapping: Mapping[str, str] | None = None,
    lookback_days: int | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Load what is not loaded yet. Returns (rows per table, new control table).

    The source is read once and kept until the sync ends, so rows that arrive meanwhile are left for
    the next run and the new mark never passes a row that was not loaded. Rows after the mark
    are loaded as they are. Rows up to it are loaded unless the backlog has their message, so rows
    that come late, in whatever order, are loaded once. Rows without a date go to the dead letters,
    once. Each sync is a load of its own: none ever takes the place of another.

    ``lookback_days`` spares the scan of what lies further before the mark; rows that arrive later
    than that are then left for a sync without it. The default leaves out nothing.
    """
    begun = time.monotonic()
    names = dict(mapping or {})
    mark = high_water_mark(marks, source_id)
    column = names.get(date_col, date_col)
    kind = source.schema[column].dataType
    with materialize(_wanted(source, mark, column, lookback_days), "sync") as kept, ExitStack() as stack:
        dated = kept.filter(name_col(column).isNotNull())
        newest = dated.agg(F.max(name_col(column)).cast("string").alias("m")).first()["m"]
        undated = stack.enter_context(not_loaded(kept.filter(name_col(column).isNull()), out_dir, "dead_letters", source_id, names))
        dead = None if undated is None else undated_orders(undated, names, source_id)
        if mark is None:
            counts = load_kept(dated, out_dir, names, source_id, None, dead)
        else:
            limit = F.lit(mark).cast(kind)
            old, later = dated.filter(name_col(column) <= limit), dated.filter(name_col(column) > limit)
            months = [r[MONTH] for r in with_month(old, column).select(MONTH).distinct().collect()]  # bounded by the calendar
            late = stack.enter_context(not_loaded(old, out_dir, "orders_backlog", source_id, names, months))
            counts = load_orders(later if late is None else later.unionByName(late), out_dir, names, source_id, None, dead)
    inserted = counts.filter("counted").agg(F.sum("rows").alias("n")).first()["n"]
    if not inserted:
        return counts, marks
    return counts, advance_marks(marks, source_id, max(mark or newest, newest), inserted, time.monotonic() - begun)


def sources_due(sources: DataFrame, marks: DataFrame, now: Any) -> DataFrame:
    """Sources never synced, or synced longer ago than their interval; an interval of 0 is manual."""
    hours = (
        F.coalesce("sync_interval_hours", F.lit(DEFAULT_INTERVAL_HOURS))
        if "sync_interval_hours" in sources.columns
        else F.lit(DEFAULT_INTERVAL_HOURS)
    )
    moment = F.lit(now).cast("timestamp")
    joined = sources.join(
        marks.select(F.col("source_id").alias("id"), F.col("last_synced_at").alias("_mark")), on="id", how="left"
    )
    age = F.unix_micros(moment) - F.unix_micros(F.col("_mark").cast("timestamp"))
    due = F.col("_mark").isNull() | (age > hours.cast("double") * 3_600_000_000)
    return joined.filter((hours != 0) & due).drop("_mark")
