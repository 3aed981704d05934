"""Answers in the shape they are given: lists cut with totals, pages, noise dropped, what is worth showing, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compact_keys(fields: dict[str, Column], drop_false: tuple = ()) -> Column:
    """Names of the fields that say something, in order: not null, not an empty list or object, not a false flag of drop_false.
    Fields are strings but for the flags."""
    says = {k: v.isNotNull() & ((F.coalesce(v, F.lit(False)) == True) if k in drop_false else ~F.coalesce(v.cast("string"), F.lit("")).isin("[]", "{}")) for k, v in fields.items()}  # noqa: E712
    return F.array_compact(F.array(*[F.when(v, k) for k, v in says.items()]))


def compact(fields: dict[str, Column], drop_false: tuple = ()) -> Column:
    """The same fields as a JSON object; noise is null, and null fields are left out."""
    noise = lambda k, v: (F.coalesce(v, F.lit(False)) == False) if k in drop_false else F.coalesce(v.cast("string"), F.lit("")).isin("[]", "{}")  # noqa: E712, E731
    return F.to_json(F.struct(*[F.when(~noise(k, v), v).alias(k) for k, v in fields.items()]))


def with_total(rows: DataFrame, key: list[str], value: str, most: int, name: str) -> DataFrame:
    """Per key the first most distinct values in order, their total number, and whether some are left out.

    A key of any number of values is no large task: values are made distinct first, ranks are limited before the
    window's sort, and totals are counted apart.
    """
    one = rows.select(*key, value).distinct()
    total = one.groupBy(*key).agg(F.count(F.lit(1)).alias(f"n_{name}"))
    first = one.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(value))).filter(F.col("_n") <= most)
    listed = first.groupBy(*key).agg(F.array_sort(F.collect_list(value)).alias(name))
    return total.join(listed, key).withColumn(f"{name}_cut", F.col(f"n_{name}") > most)


def page_after(rows: DataFrame, keys: list[str], cursor: list, size: int) -> DataFrame:
    """The next size rows in order of keys after the cursor; the cursor is pushed down as a filter, no offset is counted."""
    after = F.struct(*[F.col(k) for k in keys]) > F.struct(*[F.lit(c).alias(k) for k, c in zip(keys, cursor)])
    return rows.filter(after).orderBy(*keys).limit(size)


def runs_shown(runs: DataFrame, key: str = "collection") -> DataFrame:
    """Runs (state, started_at, id) with shown: all that are not ok, and the newest ok one of each key."""
    newest = runs.filter("state = 'ok'").groupBy(key).agg(F.max(F.struct("started_at", "id")).alias("_b"))
    out = runs.join(newest.select(key, F.col("_b.id").alias("_newest")), key, "left")
    return out.withColumn("shown", (F.col("state") != "ok") | F.coalesce(F.col("id") == F.col("_newest"), F.lit(False))).drop("_newest")


def snapshots_shown(snapshots: DataFrame) -> DataFrame:
    """Snapshots (repo, head_status) with shown: the current ones, and all of a repo that has none."""
    fresh = snapshots.filter("head_status = 'current'").select("repo", F.lit(True).alias("_fresh")).distinct()
    return snapshots.join(fresh, "repo", "left").withColumn("shown", (F.col("head_status") == "current") | F.col("_fresh").isNull()).drop("_fresh")


def rate(done, seconds) -> Column:
    """Items a second; null where no time has passed."""
    return F.when(seconds > 0, done / seconds)


def remaining_seconds(done, selected, seconds) -> Column:
    """Seconds to go at the rate so far; null if nothing is left, done or timed."""
    return F.when((selected > done) & (done > 0) & (seconds > 0), (selected - done) * seconds / done)


def tokens_estimated(text) -> Column:
    return F.ceil(F.length(text) / 4)


def under_prefix(path, prefix: str) -> Column:
    """Whether a stored path, with its repo in front or without, begins with prefix."""
    return path.startswith(prefix) | F.regexp_replace(path, "^[^/]*/", "").startswith(prefix) & F.contains(path, F.lit("/"))


def not_embedded(records: DataFrame, *keys: str) -> DataFrame:
    """Per filter value the records and the embedded ones, and whether a semantic search there can find nothing though records exist."""
    out = records.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_records"), F.count("embedding").alias("n_embedded"))
    return out.withColumn("nothing_to_find", F.col("n_embedded") == 0)
