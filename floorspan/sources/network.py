"""Network layers: catalogs, extracts, exports and reprojection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floorspan.functions import geo
from floorspan.session import cut

#: Layers that a network has to have.
NEEDED = ("net_junction", "net_path")


def catalog(rows: DataFrame) -> DataFrame:
    """(layer, n, families) of rows (layer, family); and fields, the sorted names in a map column properties, where there is one."""
    more = [F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("properties"))))).alias("fields")] if "properties" in rows.columns else []
    return rows.groupBy("layer").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("family")).alias("families"), *more)


def floors_of(rows: DataFrame, floor: str) -> DataFrame:
    """(n, floors): rows and their distinct floors in order."""
    return rows.agg(F.count("*").alias("n"), F.array_sort(F.collect_set(floor)).alias("floors"))


def to_degrees(rows: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Web Mercator metres to degrees; rows without coordinates are dropped (``skipped`` counts them)."""
    lon, lat = geo.mercator_to_degrees(F.col(x), F.col(y))
    return rows.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).withColumns({"lon": lon, "lat": lat})


def skipped(rows: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return rows.groupBy("layer").agg(F.count_if(F.col(x).isNull() | F.col(y).isNull()).alias("skipped"))


def export_paths(edges: DataFrame) -> DataFrame:
    """Every edge (edge_index, from_id, to_id, cost) twice: forward with id 2k + 1 and back with id 2k + 2."""
    there = F.struct((F.col("edge_index") * 2 + 1).alias("path_id"), (F.col("edge_index") * 2 + 2).alias("back_id"), F.col("from_id").alias("f"), F.col("to_id").alias("t"))
    back = F.struct((F.col("edge_index") * 2 + 2).alias("path_id"), (F.col("edge_index") * 2 + 1).alias("back_id"), F.col("to_id").alias("f"), F.col("from_id").alias("t"))
    return edges.select(F.explode(F.array(there, back)).alias("p"), "cost").select("p.path_id", "p.back_id", F.col("p.f").alias("from_id"), F.col("p.t").alias("to_id"), "cost")


def reachable(edges: DataFrame, root: DataFrame) -> DataFrame:
    """(path, depth) of all that a package's root reaches over (parent, child) edges, by the fewest steps."""
    found = cut(root.select("path", F.lit(0).alias("depth")))
    front, k = found, 0
    while True:
        k += 1
        step = front.join(edges, front["path"] == edges["parent"]).select(F.col("child").alias("path")).distinct()
        front = cut(step.join(found, "path", "left_anti").withColumn("depth", F.lit(k)))
        if front.isEmpty():
            return found
        found = cut(found.union(front))


def walk(entries: DataFrame, edges: DataFrame, root: DataFrame) -> DataFrame:
    """(path, depth, ignored) of a package's entries (path): how far each is from the root, and whether nothing leads to it."""
    d = entries.join(reachable(edges, root), "path", "left")
    return d.select("path", "depth", F.col("depth").isNull().alias("ignored"))


def write_network(junctions: DataFrame, paths: DataFrame, folder: str) -> None:
    """The two layers as GeoJSON lines; a proprietary geodatabase file needs a driver that Spark doesn't have."""
    for name, df in zip(NEEDED, (junctions, paths), strict=True):
        df.select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(f"{folder}/{name}")


def read_network(spark: SparkSession, folder: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    """The layers that ``write_network`` wrote, by name, with the given schemas."""
    return {name: spark.read.text(f"{folder}/{name}").select(F.from_json("value", schemas[name]).alias("r")).select("r.*") for name in NEEDED}
