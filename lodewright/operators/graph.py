"""The call graph: resolving targets, related edges, blast radius."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VALUE_KINDS, TYPE_KINDS = ("function", "method", "constant", "class", "enum", "shell_function"), ("interface", "type")  # fixed values


def last_part(symbol) -> Column:
    """The part after the last dot; a::b stays whole."""
    return F.substring_index(symbol, ".", -1)


def directory(path) -> Column:
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "/[^/]*$", "")).otherwise(path)


def kind_rank(kind) -> Column:
    return F.when(kind.isin(*VALUE_KINDS), 0).when(kind.isin(*TYPE_KINDS), 2).otherwise(1)


def resolvable(edges: DataFrame) -> DataFrame:
    """Edges without target whose symbol may be resolved."""
    may = F.coalesce(F.lower(F.get_json_object("metadata", "$.target_resolvable")), F.lit("true")) != "false"
    return edges.filter(F.col("target_record_id").isNull() & F.col("target_symbol").isNotNull() & may)


def resolve_targets(edges: DataFrame, definitions: DataFrame) -> DataFrame:
    """(id, resolved_record_id) of resolvable edges that find a definition (snapshot_id, record_id, symbol, source_path, symbol_kind).

    A symbol means the definitions of that symbol; without any, those of the one symbol that has its last part as
    last part. Of these the one in the same file, else the same directory, else any. Definitions are brought down
    to the best of each (symbol, file), (symbol, directory) and symbol first, so common names make no pairs.
    """
    d = definitions.select("snapshot_id", "record_id", "symbol", F.col("source_path").alias("path"), kind_rank(F.col("symbol_kind")).alias("kind")).filter("symbol IS NOT NULL")
    at = ["snapshot_id", "symbol"]
    in_file = d.groupBy(*at, "path").agg(F.min(F.struct("kind", "record_id"))["record_id"].alias("in_file"))
    in_dir = d.groupBy(*at, directory(F.col("path")).alias("dir")).agg(F.min(F.struct("path", "kind", "record_id"))["record_id"].alias("in_dir"))
    anywhere = d.groupBy(*at).agg(F.min(F.struct("kind", "path", "record_id"))["record_id"].alias("anywhere"))
    tails = d.groupBy("snapshot_id", last_part(F.col("symbol")).alias("tail")).agg(F.min("symbol").alias("lo"), F.max("symbol").alias("hi")).filter("lo = hi").select("snapshot_id", "tail", F.col("lo").alias("by_tail"))
    e = resolvable(edges).select("id", "snapshot_id", "target_symbol", F.col("source_path").alias("path"))
    wants = e.select("snapshot_id", "target_symbol").distinct().withColumn("tail", last_part(F.col("target_symbol")))
    exact = anywhere.select("snapshot_id", F.col("symbol").alias("target_symbol"), F.lit(True).alias("exact"))
    meant = wants.join(exact, ["snapshot_id", "target_symbol"], "left").join(tails, ["snapshot_id", "tail"], "left")
    meant = meant.select("snapshot_id", "target_symbol", F.when(F.col("exact"), F.col("target_symbol")).otherwise(F.col("by_tail")).alias("symbol")).filter("symbol IS NOT NULL")
    out = e.join(meant, ["snapshot_id", "target_symbol"]).withColumn("dir", directory(F.col("path")))
    out = out.join(in_file, [*at, "path"], "left").join(in_dir, [*at, "dir"], "left").join(anywhere, at, "left")
    return out.select("id", F.coalesce("in_file", "in_dir", "anywhere").alias("resolved_record_id"))


def related(edges: DataFrame, symbol: str, limit: int, include_unresolved: bool = True) -> DataFrame:
    """Edges at a symbol, incoming and outgoing in turn, resolved first, newest first; self edges left out."""
    e = edges.filter(F.col("target_record_id").isNull() | ~F.col("source_record_id").eqNullSafe(F.col("target_record_id")))
    if not include_unresolved:
        e = e.filter("target_record_id IS NOT NULL OR confidence_kind <> 'heuristic_candidate'")
    side = lambda c, n: e.filter(F.col(c) == symbol).withColumn("direction", F.lit(n))
    order = [F.desc(F.col("target_record_id").isNotNull()), F.desc("id")]
    sides = [side("target_symbol", 0), side("source_symbol", 1)]
    sides = [s.orderBy(*order).limit(limit).withColumn("place", F.row_number().over(Window.orderBy(*order))) for s in sides]  # of limit rows
    both = sides[0].unionByName(sides[1])
    first = both.withColumn("n", F.row_number().over(Window.partitionBy("id").orderBy("place", "direction"))).filter("n = 1")
    return first.orderBy("place", "direction").limit(limit)


def blast_radius(definitions: DataFrame, edges: DataFrame, tests: DataFrame) -> DataFrame:
    """Per definition (snapshot_id, record_id, symbol, source_path): callers, test files among them, callees, mentions
    of the bare name, and whether it looks orphaned. tests is (snapshot_id, source_path, is_test). Each count is
    an aggregate before its join, so a hot callee is one row by then.
    """
    calls = edges.filter("edge_type = 'call_candidate'")
    not_self = ~F.col("source_record_id").eqNullSafe(F.col("target_record_id"))
    inbound = calls.filter(F.col("target_record_id").isNotNull() & not_self).join(tests, ["snapshot_id", "source_path"], "left")
    per_file = inbound.groupBy("snapshot_id", F.col("target_record_id").alias("record_id"), "source_path").agg(F.count(F.lit(1)).alias("n"), F.max(F.coalesce("is_test", F.lit(False))).alias("t"))
    inbound = per_file.groupBy("snapshot_id", "record_id").agg(F.sum("n").alias("n_callers"), F.count_if("t").alias("n_test_files"))
    callees = calls.filter(F.col("target_symbol").isNotNull() & not_self).groupBy("snapshot_id", F.col("source_record_id").alias("record_id")).agg(F.countDistinct("target_symbol").alias("n_callees"))
    named = edges.filter("target_symbol IS NOT NULL").groupBy("snapshot_id", F.col("target_symbol").alias("bare")).agg(F.count(F.lit(1)).alias("n_named"))
    own = edges.filter("target_symbol IS NOT NULL").groupBy("snapshot_id", F.col("target_symbol").alias("bare"), F.col("source_record_id").alias("record_id")).agg(F.count(F.lit(1)).alias("n_own"))
    d = definitions.select("snapshot_id", "record_id", "symbol", "source_path").distinct().withColumn("bare", last_part(F.col("symbol")))
    out = d.join(inbound, ["snapshot_id", "record_id"], "left").join(callees, ["snapshot_id", "record_id"], "left").join(named, ["snapshot_id", "bare"], "left").join(own, ["snapshot_id", "bare", "record_id"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    out = out.select("snapshot_id", "record_id", "symbol", "source_path", "bare", zero("n_callers").alias("n_callers"), zero("n_test_files").alias("n_test_files"), zero("n_callees").alias("n_callees"), (zero("n_named") - zero("n_own")).alias("n_name_refs"))
    return out.withColumn("looks_orphaned", (F.col("n_callers") == 0) & (F.col("n_name_refs") == 0) & (F.col("bare") != "main")).drop("bare")
