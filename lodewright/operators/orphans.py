"""References to records that do not exist, direct and inherited.

A reference is a direct orphan if nothing it could mean exists where and when it is made. Children of
orphaned records are orphans too: from the records whose parent is missing, semi-joins run down the
parent keys until no new record is reached, and edges that only orphaned records answer inherit it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewright.session import cut
from lodewright.tables import counting_files, is_set

SCOPE = ["collection", "repo", "sha"]
EDGES, RECORDS = "project_code_intel_edges", "project_code_intel_records"


def _tail(symbol) -> F.Column:
    """The part after the last dot, all of it if there is no dot."""
    return F.substring_index(symbol, ".", -1)


def _records(records: DataFrame) -> DataFrame:
    return records.select("id", "collection", "repo", "source_path", F.lower("file_sha256").alias("sha"), "record_type", "record_id", "parent_record_id", "symbol", "created_at")


def orphan_records(records: DataFrame) -> DataFrame:
    """(id, collection, repo, sha, record_id, created_at, hops): records whose parent is missing (hops 0) or orphaned.

    Each round is one semi-join of the records' parent keys with the last round's distinct orphans;
    rounds end when none is new, so a ring of parents ends too.
    """
    r = _records(records)
    child = r.filter(is_set(F.col("parent_record_id")))
    here = r.filter("record_id IS NOT NULL").select(*[F.col(c).alias(f"k_{c}") for c in [*SCOPE, "record_id"]]).distinct()
    on = [child[c].eqNullSafe(here[f"k_{c}"]) for c in SCOPE] + [child["parent_record_id"] == here["k_record_id"]]
    keep = ["id", *SCOPE, "record_id", "parent_record_id", "created_at"]
    found = cut(child.join(here, on, "left_anti").select(*keep, F.lit(0).alias("hops")).dropDuplicates(["id"]))
    frontier, hops = found, 0
    while not frontier.isEmpty():
        hops += 1
        above = frontier.filter("record_id IS NOT NULL").select(*[F.col(c).alias(f"k_{c}") for c in [*SCOPE, "record_id"]]).distinct()
        on = [child[c].eqNullSafe(above[f"k_{c}"]) for c in SCOPE] + [child["parent_record_id"] == above["k_record_id"]]
        below = child.join(above, on, "left_semi").select(*keep, F.lit(hops).alias("hops")).dropDuplicates(["id"])
        frontier = cut(below.join(found.select("id"), "id", "left_anti"))
        found = found.unionByName(frontier)
    return found


def _answers(records: DataFrame, files: DataFrame, orphans: DataFrame) -> DataFrame:
    """(snapshot_id, kind, key, since, sound_since): when a key first existed in a snapshot, by any and by an unorphaned record.

    kind r: key is a record_id; kind s: key is the last part of a definition's symbol.
    Records delivered twice change no minimum, so they need no shuffle of their own.
    """
    bad = orphans.select("id").distinct().withColumn("bad", F.lit(True))
    r = _records(records).join(bad, "id", "left")
    keys = F.array(
        F.struct(F.lit("r").alias("kind"), F.col("record_id").alias("key")),
        F.struct(F.lit("s").alias("kind"), F.when(F.col("record_type") == "symbol_definition", _tail(F.col("symbol"))).alias("key")),
    )
    r = r.select("collection", "repo", "source_path", "sha", "created_at", "bad", F.inline(keys)).filter("key IS NOT NULL")
    r = r.groupBy("collection", "repo", "source_path", "sha", "kind", "key").agg(F.min("created_at").alias("since"), F.min(F.when(F.col("bad").isNull(), F.col("created_at"))).alias("sound"))
    f = counting_files(files, "collection", "repo", "file_sha256").withColumn("sha", F.lower("file_sha256")).filter("sha IS NOT NULL")
    seen = r.join(f, ["collection", "repo", "source_path", "sha"])
    return seen.groupBy("snapshot_id", "kind", "key").agg(F.min("since").alias("since"), F.min("sound").alias("sound_since"))


def orphan_references(edges: DataFrame, files: DataFrame, records: DataFrame) -> DataFrame:
    """(table_name, row_id, field_name, created_at, origin): every orphan reference; origin is direct or inherited.

    For edges source_record_id, target_record_id and target_symbol; for records parent_record_id. Null and
    empty keys are no references; a null created_at of the edge makes its set references orphans, as nothing
    is known to have existed by then. Rows delivered twice give one row. Keys are compared exactly, hex
    digests without case. Empty tables give no rows; extra columns are ignored.
    """
    orphans = orphan_records(records)
    e = edges.select("id", "snapshot_id", "source_record_id", "target_record_id", "target_symbol", "created_at", F.lower(F.get_json_object("metadata", "$.target_resolvable")).alias("resolvable"))
    no_target = ~is_set(F.coalesce(F.col("target_record_id"), F.lit("")))
    resolvable = F.coalesce(F.col("resolvable"), F.lit("true")) != "false"
    refs = F.array(
        F.struct(F.lit("source_record_id").alias("field_name"), F.lit("r").alias("kind"), F.col("source_record_id").alias("key")),
        F.struct(F.lit("target_record_id").alias("field_name"), F.lit("r").alias("kind"), F.col("target_record_id").alias("key")),
        F.struct(F.lit("target_symbol").alias("field_name"), F.lit("s").alias("kind"), F.when(is_set(F.col("target_symbol")) & no_target & resolvable, _tail(F.col("target_symbol"))).alias("key")),
    )
    refs = e.select("id", "snapshot_id", "created_at", F.inline(refs)).filter(F.col("key").isNotNull() & ((F.col("kind") == "s") | (F.col("key") != "")))
    answered = refs.join(_answers(records, files, orphans), ["snapshot_id", "kind", "key"], "left")
    by_then = lambda c: F.coalesce(F.col(c) <= F.col("created_at"), F.lit(False))
    origin = F.when(~by_then("since"), "direct").when(~by_then("sound_since"), "inherited")
    of_edges = answered.select(F.lit(EDGES).alias("table_name"), F.col("id").alias("row_id"), "field_name", "created_at", origin.alias("origin")).filter("origin IS NOT NULL").dropDuplicates(["row_id", "field_name"])
    of_records = orphans.select(F.lit(RECORDS).alias("table_name"), F.col("id").alias("row_id"), F.lit("parent_record_id").alias("field_name"), "created_at", F.when(F.col("hops") == 0, "direct").otherwise("inherited").alias("origin"))
    return of_edges.unionByName(of_records)


def orphan_report(found: DataFrame) -> DataFrame:
    """Counts per table, field, month of created_at and origin."""
    return found.groupBy("table_name", "field_name", F.date_format("created_at", "yyyy-MM").alias("month"), "origin").agg(F.count(F.lit(1)).alias("n_orphans"))
