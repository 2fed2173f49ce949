"""Walks along dependencies, as loops of joins over distinct frontiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .status import UNHEALTHY


def reach(edges: DataFrame, roots: DataFrame, depth: int = 10, source: str = "entity_id", to: str = "depends_on") -> DataFrame:
    """(root, node, level): every node within depth steps of a root, at its least level; the root is at level 0.

    A node is visited once for each root, so cycles end. Each step's frontier is checkpointed if the session has a folder for
    that, which cuts the lineage of long walks; else a frontier stays cached only until the next one is known.
    """
    step = edges.select(F.col(source).alias("node"), F.col(to).alias("next")).distinct()
    seen = roots.select(F.col(roots.columns[0]).alias("root"), F.col(roots.columns[0]).alias("node"), F.lit(0).alias("level"))
    frontier, cached = seen, None
    kept = bool(edges.sparkSession.conf.get("spark.checkpoint.dir", None) or edges.sparkSession.sparkContext.getCheckpointDir())
    for level in range(1, depth + 1):
        found = frontier.join(step, "node").select("root", F.col("next").alias("node")).distinct().join(seen.select("root", "node"), ["root", "node"], "left_anti").withColumn("level", F.lit(level))
        frontier = found.checkpoint() if kept else found.persist()
        last = frontier.isEmpty()
        if cached is not None:
            cached.unpersist()
        cached = None if kept else frontier
        if last:
            break
        seen = seen.unionByName(frontier)
    return seen


def tree(edges: DataFrame, entities: DataFrame, status: DataFrame, roots: DataFrame, depth: int = 5) -> DataFrame:
    """All that the roots depend on (direction dependency) and all that depends on them (dependent), with level, status and critical mark.

    Direct neighbours have level 0 and the deepest level is `depth`. A node that several paths reach comes once, at its least
    level, with the mark of an edge that leads to it there.
    """
    out = None
    for name, source, to in (("dependency", "entity_id", "depends_on"), ("dependent", "depends_on", "entity_id")):
        found = reach(edges, roots, depth + 1, source, to)
        by = edges.select(F.col(source).alias("from"), F.col(to).alias("node"), F.col("is_critical"))
        before = found.select("root", F.col("node").alias("from"), (F.col("level") + 1).alias("level"))
        marked = found.where("level > 0").join(by, "node").join(before, ["root", "from", "level"]).groupBy("root", "node", "level").agg(F.max("is_critical").alias("is_critical"))
        one = marked.select("root", F.lit(name).alias("direction"), F.col("node").alias("entity_id"), (F.col("level") - 1).alias("level"), "is_critical")
        out = one if out is None else out.unionByName(one)
    facts = entities.select("entity_id", "entity_type").join(status.select("entity_id", "status"), "entity_id", "left")
    return out.join(facts, "entity_id").select("root", "direction", "entity_id", "level", "entity_type", F.coalesce("status", F.lit("Unknown")).alias("status"), "is_critical")


def impact(edges: DataFrame, entities: DataFrame, status: DataFrame, depth: int = 5) -> DataFrame:
    """For each entity: unhealthy entities that it depends on (root causes), and how many critical and unhealthy ones depend on it."""
    nodes = entities.select("entity_id")
    facts = entities.join(status.select("entity_id", "status"), "entity_id", "left").select(F.col("entity_id").alias("node"), "is_critical", F.coalesce(F.col("status").isin(*UNHEALTHY), F.lit(False)).alias("ill"))
    up = reach(edges, nodes, depth).where("level > 0").join(facts, "node").groupBy("root").agg(F.count("*").alias("upstream"), F.count_if("ill").alias("root_causes"))
    down = reach(edges, nodes, depth, "depends_on", "entity_id").where("level > 0").join(facts, "node").groupBy("root").agg(F.count("*").alias("downstream"), F.count_if("is_critical").alias("critical"), F.count_if("ill").alias("unhealthy"))
    out = nodes.withColumnRenamed("entity_id", "root").join(up, "root", "left").join(down, "root", "left")
    return out.na.fill(0).withColumnRenamed("root", "entity_id")


def audience(closure: DataFrame, contacts: DataFrame) -> DataFrame:
    """Distinct addresses, ignoring case and blanks, of the active contacts of all nodes reached."""
    tidy = F.lower(F.trim("email"))
    return closure.select("node").distinct().join(contacts.where("is_active"), closure["node"] == contacts["entity_id"]).where(tidy != "").select(tidy.alias("email")).distinct()
