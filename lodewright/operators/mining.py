"""Repeated call shapes: functions with alike sets of callee roles, clustered and scored.

Everything is per snapshot. Functions with the same role set are one class; classes are compared by an inverted
index over the roles that a pair of enough likeness must share, rarest first, and only class pairs carry likeness.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewright.operators.components import connected_components
from lodewright.operators.graph import directory, last_part
from lodewright.session import cut

THRESHOLD, MIN_ROLES, REPS = 0.6, 3, 3


def role(callee) -> Column:
    """The first word of the last dotted part, in lower case: leading _ off, split at other marks, then at case changes."""
    bare = F.regexp_replace(last_part(callee), "^_+", "")
    words = F.split(F.regexp_replace(F.regexp_replace(bare, "[^A-Za-z0-9]+", " "), "(?<=[a-z0-9])(?=[A-Z])", " "), " ")
    return F.lower(words[0])


def function_nodes(definitions: DataFrame, edges: DataFrame) -> DataFrame:
    """(snapshot_id, record_id, symbol, source_path, loc, roles, callees) of functions and methods; at most one row a key."""
    d = definitions.filter("symbol_kind IN ('function', 'method')").groupBy("snapshot_id", "record_id").agg(F.min("symbol").alias("symbol"), F.min("source_path").alias("source_path"), F.min(F.col("line_end") - F.col("line_start") + 1).alias("loc"))
    c = edges.filter("target_symbol IS NOT NULL AND source_record_id IS NOT NULL").select("snapshot_id", F.col("source_record_id").alias("record_id"), role(F.col("target_symbol")).alias("role"), last_part(F.col("target_symbol")).alias("callee"))
    c = c.groupBy("snapshot_id", "record_id").agg(F.array_sort(F.collect_set(F.when(F.col("role") != "", F.col("role")))).alias("roles"), F.array_sort(F.collect_set("callee")).alias("callees"))
    none = F.array().cast("array<string>")
    return d.join(c, ["snapshot_id", "record_id"], "left").withColumns({"roles": F.coalesce("roles", none), "callees": F.coalesce("callees", none)})


def fold_clones(nodes: DataFrame) -> DataFrame:
    """One node of each (symbol, role set, loc), at the least path, with the number folded into it."""
    best = F.min_by(F.struct("record_id", "source_path", "callees"), F.struct("source_path", "record_id")).alias("b")
    g = nodes.groupBy("snapshot_id", "symbol", "roles", "loc").agg(best, F.count(F.lit(1)).alias("n_folded"))
    return g.select("snapshot_id", "b.record_id", "symbol", "b.source_path", "loc", "roles", "b.callees", "n_folded")


def role_weights(nodes: DataFrame) -> DataFrame:
    """(snapshot_id, role, weight): ln(N / df), 0 for a role every node has."""
    n = nodes.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))
    df = nodes.select("snapshot_id", F.explode("roles").alias("role")).groupBy("snapshot_id", "role").agg(F.count(F.lit(1)).alias("df"))
    return df.join(n, "snapshot_id").select("snapshot_id", "role", F.log(F.col("n") / F.col("df")).alias("weight"))


def role_classes(nodes: DataFrame) -> DataFrame:
    """(snapshot_id, cls, roles, n) of eligible nodes: those with at least three roles."""
    g = nodes.filter(F.size("roles") >= MIN_ROLES).groupBy("snapshot_id", "roles").agg(F.count(F.lit(1)).alias("n"))
    return g.withColumn("cls", F.xxhash64("snapshot_id", F.array_join("roles", "\u0001")))


def similar_classes(classes: DataFrame, weights: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(snapshot_id, a, b, likeness), a < b: class pairs with weighted Jaccard of at least threshold.

    Such a pair shares weight of at least threshold times either's total, so it shares a role among those that,
    rarest first, come before the rest weighs less than that.
    """
    w = classes.select("snapshot_id", "cls", F.explode("roles").alias("role")).join(weights, ["snapshot_id", "role"])
    full = w.groupBy("snapshot_id", "cls").agg(F.sum("weight").alias("total"), F.sort_array(F.collect_list(F.struct((-F.col("weight")).alias("w"), "role"))).alias("ws"))
    running = F.aggregate("ws", F.struct(F.lit(0.0).alias("seen"), F.array().cast("array<string>").alias("keep")), lambda acc, x: F.struct((acc["seen"] - x["w"]).alias("seen"), F.when(F.col("total") - acc["seen"] >= threshold * F.col("total") - 1e-12, F.array_append(acc["keep"], x["role"])).otherwise(acc["keep"]).alias("keep")))
    full = cut(full.filter("total > 0").select("snapshot_id", "cls", "total", F.map_from_entries(F.transform("ws", lambda x: F.struct(x["role"], -x["w"]))).alias("m"), running["keep"].alias("prefix")))
    post = full.select("snapshot_id", "cls", F.explode("prefix").alias("role"))
    met = post.withColumnRenamed("cls", "a").join(post.withColumnRenamed("cls", "b"), ["snapshot_id", "role"]).filter("a < b").select("snapshot_id", "a", "b").distinct()
    side = lambda c: full.select("snapshot_id", F.col("cls").alias(c), F.col("total").alias(f"t{c}"), F.col("m").alias(f"m{c}"))
    both = met.join(side("a"), ["snapshot_id", "a"]).join(side("b"), ["snapshot_id", "b"])
    shared = F.aggregate(F.array_sort(F.array_intersect(F.map_keys("ma"), F.map_keys("mb"))), F.lit(0.0), lambda acc, r: acc + F.col("ma")[r])
    both = both.withColumn("shared", shared).withColumn("likeness", F.col("shared") / (F.col("ta") + F.col("tb") - F.col("shared")))
    return both.filter(F.col("likeness") >= threshold - 1e-12).select("snapshot_id", "a", "b", "likeness")


def _chain(x: str, y: str) -> Column:
    """Whether one of two nodes calls the other by its last part."""
    call = lambda p, q: F.array_contains(f"{p}.callees", last_part(F.col(f"{q}.symbol")))
    return call(x, y) | call(y, x)


def node_links(nodes: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Links (u, v) that connect what all pairs of alike nodes that are no call chain connect.

    Members link to the first of their class's REPS least members that is no call chain with them, and alike classes
    by their representatives; only where every representative is a chain are all members tried.
    """
    key = F.concat_ws("\u0001", F.col("snapshot_id").cast("string"), "record_id")
    n = nodes.filter(F.size("roles") >= MIN_ROLES).join(classes.select("snapshot_id", "roles", "cls"), ["snapshot_id", "roles"]).select("cls", key.alias("key"), "symbol", "callees")
    n = cut(n)
    sized = n.groupBy("cls").agg(F.min("key").alias("k1"))
    for i in range(1, REPS):
        more = n.join(sized, "cls").filter(F.col("key") > F.col(f"k{i}")).groupBy("cls").agg(F.min("key").alias(f"k{i + 1}"))
        sized = sized.join(more, "cls", "left")
    rep_keys = sized.select("cls", F.explode(F.array_compact(F.array(*[f"k{i + 1}" for i in range(REPS)]))).alias("key"))
    reps = cut(n.join(rep_keys, ["cls", "key"]))
    x, y = n.alias("x"), reps.alias("y")
    within = x.join(y, F.col("x.cls") == F.col("y.cls")).filter("x.key <> y.key").select(F.col("x.cls").alias("cls"), F.col("x.key").alias("u"), F.col("y.key").alias("v"), _chain("x", "y").alias("chain"))
    within = cut(within)
    stuck = within.groupBy("cls", "u").agg(F.min("chain").alias("all")).filter("all").select("cls", F.col("u").alias("key"))
    hard = n.join(stuck, ["cls", "key"]).alias("x").join(n.alias("y"), F.col("x.cls") == F.col("y.cls")).filter((F.col("x.key") != F.col("y.key")) & ~_chain("x", "y")).select(F.col("x.key").alias("u"), F.col("y.key").alias("v"))
    p = pairs.select("a", "b").alias("p")
    across = p.join(reps.alias("x"), F.col("p.a") == F.col("x.cls")).join(reps.alias("y"), F.col("p.b") == F.col("y.cls")).select("a", "b", F.col("x.key").alias("u"), F.col("y.key").alias("v"), _chain("x", "y").alias("chain"))
    across = cut(across)
    none = across.groupBy("a", "b").agg(F.min("chain").alias("all")).filter("all").alias("p")
    far = none.join(n.alias("x"), F.col("p.a") == F.col("x.cls")).join(n.alias("y"), F.col("p.b") == F.col("y.cls")).filter(~_chain("x", "y")).select(F.col("x.key").alias("u"), F.col("y.key").alias("v"))
    return within.filter("NOT chain").select("u", "v").unionByName(hard).unionByName(across.filter("NOT chain").select("u", "v")).unionByName(far)


def motif_clusters(nodes: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Members (snapshot_id, record_id, cluster, cls...), class pairs with likeness, and weights; clusters of two or more."""
    folded = cut(fold_clones(nodes))
    weights = cut(role_weights(folded))
    classes = cut(role_classes(folded))
    pairs = cut(similar_classes(classes, weights, threshold))
    comp = connected_components(node_links(folded, classes, pairs))
    key = F.concat_ws("\u0001", F.col("snapshot_id").cast("string"), "record_id")
    members = folded.withColumn("node", key).join(comp, "node").withColumnRenamed("component", "cluster").drop("node")
    return cut(members.join(classes.select("snapshot_id", "roles", "cls"), ["snapshot_id", "roles"])), pairs, weights


def motif_scores(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per cluster: size, core roles, weights shared and left over, spread, cost, redundancy, net value, recommendation.

    The mean likeness over all member pairs is summed over class pairs times their sizes; pairs below the threshold,
    which single linkage can bring together, are computed for the cluster's classes.
    """
    members, pairs, weights = motif_clusters(nodes, threshold)
    k = members.groupBy("snapshot_id", "cluster").agg(F.count(F.lit(1)).alias("k"), F.countDistinct(directory(F.col("source_path"))).alias("n_dirs"), F.sum("loc").alias("loc_sum"), F.max("loc").alias("loc_max"), F.count("loc").alias("loc_n"), F.min("source_path").alias("first_path"))
    roles = members.select("snapshot_id", "cluster", F.explode("roles").alias("role")).groupBy("snapshot_id", "cluster", "role").agg(F.count(F.lit(1)).alias("c"))
    roles = roles.join(weights, ["snapshot_id", "role"]).join(k.select("snapshot_id", "cluster", "k"), ["snapshot_id", "cluster"])
    core = (F.col("c") >= F.greatest(F.col("k") / 2, F.lit(1.0))) & (F.col("weight") > 0)
    r = roles.groupBy("snapshot_id", "cluster").agg(F.sum(F.when(core, F.col("weight")).otherwise(0.0)).alias("shared"), F.sum(F.when(core, 0.0).otherwise(F.col("weight"))).alias("residual"), F.array_join(F.array_sort(F.collect_set(F.when(core, F.col("role")))), ",").alias("core_roles"))
    cls = cut(members.groupBy("snapshot_id", "cluster", "cls").agg(F.count(F.lit(1)).alias("n"), F.any_value("roles").alias("roles")))
    a, b = cls.select("snapshot_id", "cluster", F.col("cls").alias("a"), F.col("n").alias("na"), F.col("roles").alias("ra")), cls.select("snapshot_id", "cluster", F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("roles").alias("rb"))
    two = a.join(b, ["snapshot_id", "cluster"]).filter("a < b")
    each = two.select("snapshot_id", "cluster", "a", "b", "na", "nb", F.explode(F.array_union("ra", "rb")).alias("role"), "ra", "rb").join(weights, ["snapshot_id", "role"])
    both = F.array_contains("ra", F.col("role")) & F.array_contains("rb", F.col("role"))
    likeness = each.groupBy("snapshot_id", "cluster", "a", "b", "na", "nb").agg((F.sum(F.when(both, F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("j"))
    cross = likeness.groupBy("snapshot_id", "cluster").agg(F.sum(F.col("j") * F.col("na") * F.col("nb")).alias("cross"))
    inner = cls.groupBy("snapshot_id", "cluster").agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("inner"))
    g = k.join(r, ["snapshot_id", "cluster"]).join(inner, ["snapshot_id", "cluster"]).join(cross, ["snapshot_id", "cluster"], "left")
    avg = (F.col("inner") + F.coalesce("cross", F.lit(0.0))) / (F.col("k") * (F.col("k") - 1) / 2)
    g = g.withColumn("avg_similarity", avg).withColumn("cost", 1 + F.col("residual") + 0.5 * F.greatest(F.col("n_dirs") - 1, F.lit(0)))
    g = g.withColumn("redundancy", (F.col("k") - 1) * F.col("shared") * F.pow("avg_similarity", F.lit(2))).withColumn("net", F.col("redundancy") - F.col("cost"))
    advice = F.when(F.col("net") <= 0, "leave-as-is").when(F.col("residual") > F.col("shared"), "parameterize-carefully").otherwise("worth-collapsing")
    loc = F.when(F.col("loc_n") >= 2, F.col("loc_sum") - F.col("loc_max"))
    return g.select("snapshot_id", "cluster", "k", "n_dirs", "core_roles", "shared", "residual", "avg_similarity", "cost", "redundancy", "net", (F.col("redundancy") / F.col("cost")).alias("ratio"), loc.alias("est_loc"), advice.alias("recommendation"))


def duplicate_names(definitions: DataFrame) -> DataFrame:
    """(snapshot_id, name, n_paths, paths): bare names defined at more than one path; the hundred least paths are shown."""
    p = definitions.select("snapshot_id", last_part(F.col("symbol")).alias("name"), "source_path").distinct()
    n = p.groupBy("snapshot_id", "name").agg(F.count(F.lit(1)).alias("n_paths"), F.min("source_path").alias("first_path"), F.max("source_path").alias("last_path"))
    return n.filter("n_paths > 1")
