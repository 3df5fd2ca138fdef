"""Bundles: a version's sections as Parquet tables with a directory of counts and digests."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sections that a bundle has to have; others degrade one by one.
NEEDED = ("manifest", "levels", "features")


def digest(df: DataFrame) -> DataFrame:
    """(rows, digest): a digest that doesn't depend on the order of rows."""
    h = F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)")).cast("string").alias("digest"))


def write_bundle(sections: dict[str, DataFrame], folder: str) -> None:
    """Sections first, the directory last: a folder without a directory is no bundle."""
    entries = []
    for name, df in sections.items():
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/section={name}")
    spark = next(iter(sections.values())).sparkSession
    for name in sections:
        r = digest(spark.read.parquet(f"{folder}/section={name}")).first()
        entries.append((name, r["rows"], r["digest"]))
    spark.createDataFrame(entries, "section string, rows long, digest string").coalesce(1).write.mode("overwrite").json(f"{folder}/directory")


def read_bundle(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Sections that are whole, and (section, state): ok, changed or missing.  A needed section that isn't whole is an error."""
    directory = spark.read.schema("section string, rows long, digest string").json(f"{folder}/directory").collect()  # a few sections
    out, states = {}, []
    for r in directory:
        try:
            df = spark.read.parquet(f"{folder}/section={r.section}")
            state = "ok" if tuple(digest(df).first()) == (r.rows, r.digest) else "changed"
        except AnalysisException:  # its folder isn't there, or holds no table
            state = "missing"
        states.append((r.section, state))
        if state == "ok":
            out[r.section] = df
    broken = [s for s in NEEDED if s in dict(states) and dict(states)[s] != "ok"]
    if broken:
        raise ValueError(f"bundle section {broken[0]} is {dict(states)[broken[0]]}")
    return out, spark.createDataFrame(states, "section string, state string")


def inspect(sections: dict[str, DataFrame]) -> DataFrame:
    """(kind, id, level_id): the level ids of a bundle, and its features with the levels that they are on."""
    levels = sections["levels"].select(F.lit("level").alias("kind"), F.col("level_id").alias("id"), F.lit(None).cast("string").alias("level_id"))
    return levels.union(sections["features"].select(F.lit("feature"), F.col("id").cast("string"), "level_id"))


def integrity(levels: DataFrame, features: DataFrame) -> DataFrame:
    """(code, id): level rows without a feature, level features without a row, features of unknown levels, repeated ids."""
    of_level = features.filter("feature_type = 'level'").select("id")
    rows = levels.select(F.col("level_id").alias("id"))
    parts = [
        rows.join(of_level, "id", "left_anti").select(F.lit("level_without_feature").alias("code"), "id"),
        of_level.join(rows, "id", "left_anti").select(F.lit("feature_without_level").alias("code"), "id"),
        features.filter("level_id is not null").join(levels.select("level_id"), "level_id", "left_anti").select(F.lit("unknown_level").alias("code"), "id"),
        features.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("duplicate_id").alias("code"), "id"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def by_level(features: DataFrame, levels: DataFrame) -> DataFrame:
    return features.join(levels, "level_id").groupBy("level_id").agg(F.count("*").alias("features"))
