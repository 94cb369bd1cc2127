"""Shared schemas a port uses, directly or through other shared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tablepact.operators.catalog import port_references, referenced
from tablepact.sources.scratch import scratch_path, stored
from tablepact.sources.specs import Catalog

def component_edges(catalog: Catalog) -> DataFrame:
    """product, component, next: one row per reference from one shared schema to another."""
    return referenced(catalog.components, "component", "next")


def schema_closure(catalog: Catalog) -> DataFrame:
    """product, port, component: every shared schema each port uses. Cycles are safe.

    Reachability is worked out once per schema that ports name, not once per port, so a
    schema named by very many ports costs no more than one named by a single port; schemas that no port reaches cost nothing
    but the reading of their text.
    """
    named = F.count(F.lit(1)).over(Window.partitionBy("product", "port"))
    references = port_references(catalog).distinct().select("product", "port", F.col("component").alias("root"), (named == 1).alias("alone"))
    references = stored(references, "references")
    reached = reachable(references.select("product", "root").distinct(), component_edges(catalog))
    used = references.join(reached, ["product", "root"])
    # What a root reaches is distinct; only ports that name several can reach a schema twice.
    rows = lambda which: used.where(which).select("product", "port", "component")
    return rows("alone").unionAll(rows("not alone").distinct())


#: Steps from the roots that are walked one at a time, and as many again while little is left to walk; beyond them, paths are doubled.
FRONTIER = 4


def reachable(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """product, root, component: what can be reached from each root, itself included.

    A round joins the frontier, what the round before has found, to the edges, and keeps what is new: the work is that of the
    paths that roots have, whatever else the graph holds. What lies more than ``FRONTIER`` steps away is found by doubling
    steps from there on, so rounds stay few in deep graphs; but doubling takes every edge of the graph, so a frontier that has
    fallen to half of its most is walked on for as many steps. Each round is a table in shared storage, which cuts the
    lineage and survives the loss of executors; its row count is observed while it is written, at no extra pass.
    """
    folder = scratch_path(roots.sparkSession, "closure")
    steps, _ = _written(edges.select("product", "component", "next").distinct(), f"{folder}/steps")
    frontier = stored(roots.select("product", "root", F.col("root").alias("component")).distinct(), "roots")
    known = frontier
    number, most = 0, 0
    while number < FRONTIER or (number < 2 * FRONTIER and 2 * found <= most):
        number += 1
        onward = frontier.join(steps, ["product", "component"]).select("product", "root", F.col("next").alias("component")).distinct()
        fresh = onward.join(known, ["product", "root", "component"], "left_anti")
        frontier, found = _written(fresh, f"{folder}/frontier-{number}")
        if not found:
            return known
        most = max(most, found)
        known = known.unionAll(frontier)
    starts = stored(frontier.select("product", F.col("component").alias("root")).distinct(), "starts")
    beyond = _doubled(starts, stored(_live(starts, steps), "live"), folder)
    further = frontier.withColumnRenamed("root", "start").withColumnRenamed("component", "root").join(beyond, ["product", "root"])
    return known.unionAll(further.select("product", F.col("start").alias("root"), "component")).distinct()


def _live(roots: DataFrame, steps: DataFrame) -> DataFrame:
    """The steps without most of those that no walk from the roots can take.

    A pass keeps the steps that begin at a root or where a step kept so far ends; what roots reach always stays.
    """
    live, begun = steps, roots.select("product", F.col("root").alias("component"))
    for _ in range(FRONTIER):
        ends = live.select("product", F.col("next").alias("component"))
        live = steps.join(begun.unionAll(ends).distinct(), ["product", "component"], "left_semi")
    return live


def _doubled(roots: DataFrame, steps: DataFrame, folder: str) -> DataFrame:
    """As ``reachable``, in as many rounds as the longest shortest path has binary digits, and one or two more.

    A round knows what roots reach in fewer than n steps, and all walks of exactly n steps. Both joined to the walks give
    the same for 2n. A path is put together from one walk per binary digit of its length, not from every way to cut it.
    """
    started = roots.select(F.lit(True).alias("rooted"), "product", F.col("root").alias("start"), F.col("root").alias("component"))
    walks = steps.select(F.lit(False).alias("rooted"), "product", F.col("component").alias("start"), F.col("next").alias("component"))
    paths, known, found, done = started.unionAll(walks), -1, 0, 0
    while found != known:
        known, done = found, done + 1
        onward = paths.where(~F.col("rooted")).select("product", F.col("start").alias("component"), F.col("component").alias("end"))
        longer = paths.join(onward, ["product", "component"]).select("rooted", "product", "start", F.col("end").alias("component"))
        paths, found = _stored(longer.unionAll(paths.where("rooted")).distinct(), f"{folder}/round-{done}")
    return paths.where("rooted").select("product", F.col("start").alias("root"), "component")


def _stored(paths: DataFrame, path: str) -> tuple[DataFrame, int]:
    """The table of a round, written and read back, with the number of paths from roots."""
    return _written(paths, path, F.col("rooted"))


def _written(df: DataFrame, path: str, counted: Column | None = None) -> tuple[DataFrame, int]:
    """Write a table and read it back, with the number of its rows that are ``counted``."""
    seen = Observation()
    df.observe(seen, F.count_if(F.lit(True) if counted is None else counted).alias("rows")).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), seen.get["rows"]
