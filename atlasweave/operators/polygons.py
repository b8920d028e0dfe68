"""Matching polygons to places by cell, type and name."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasweave.functions import cover, geo
from atlasweave.functions.names import apply_deletes, apply_rewrites, deaccent, normalize, similarity
from atlasweave.operators.enrich import best_level, best_polygons


def _covered(polygons: DataFrame) -> DataFrame:
    """(polygon, woe, wkb) to (polygon, woe, cell): cells at the level of the type, or coarser ones of the ladder that leads to it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            out = [(p, w, c) for p, w, b, lv in zip(df["polygon"], df["woe"], df["wkb"], df["cell_level"]) for c in cover.cover(geo.shape_of(b), (int(lv),))]
            yield pd.DataFrame(out, columns=["polygon", "woe", "cell"])

    return polygons.withColumn("cell_level", geo.level_of(F.col("woe"))).select("polygon", "woe", "wkb", "cell_level").mapInPandas(run, "polygon bigint, woe int, cell bigint")


def _variants(names: DataFrame, key: str, rules: dict) -> DataFrame:
    """All normal variants of names: deaccented, without deleted words, rewritten."""
    made = F.array(F.col("name"), deaccent("name"), *([apply_deletes(F.col("name"), rules["deletes"])] if rules.get("deletes") else []))
    out = names.select(key, F.explode(F.array_distinct(made)).alias("name"))
    out = out.select(key, F.explode(apply_rewrites(F.col("name"), rules.get("rewrites", []))).alias("name"))
    return out.select(key, normalize(F.col("name")).alias("name")).where("name <> ''").distinct()


def match_polygons(polygons: DataFrame, features: DataFrame, names: DataFrame, rules: dict | None = None, least: int = 95) -> DataFrame:
    """(fid, polygon) of flattened polygons without ids: same cell and type, the best name score over ``least``, at the
    polygon's most preferred level of types that matches; of several polygons a place takes the largest id."""
    rules = rules or {}
    bare = polygons.where(F.size("fids") == 0)
    asked = bare.select("polygon", "wkb", F.posexplode("levels").alias("level", "woes")).select("polygon", "wkb", "level", F.explode("woes").alias("woe"))
    cells = _covered(asked).join(asked.select("polygon", "level", "woe"), ["polygon", "woe"])

    @F.pandas_udf(T.LongType())
    def cell_of(lat: pd.Series, lng: pd.Series, level: pd.Series) -> pd.Series:
        out = pd.Series(0, index=lat.index, dtype="int64")
        for lv in level.unique():
            m = level == lv
            out[m] = geo.cell_ids(lat[m].to_numpy(), lng[m].to_numpy(), int(lv))
        return out

    level = geo.level_of(F.col("woe"))
    centres = features.where("NOT has_poly").select("fid", "woe", level.alias("level"), cell_of("lat", "lng", level).alias("own"))
    above = F.array(*(F.when(F.col("level") >= lv, geo.cell_parent(F.col("own"), lv)) for lv in cover.ladder((10,))))
    centres = centres.select("fid", "woe", F.explode(above).alias("cell")).where("cell IS NOT NULL")
    pairs = cells.join(centres, ["cell", "woe"]).select("polygon", "level", "fid").distinct()
    pn = _variants(bare.select("polygon", F.explode("names.name").alias("name")), "polygon", rules)
    fn = _variants(names.join(pairs.select("fid").distinct(), "fid", "left_semi").select("fid", "name"), "fid", rules)
    scored = pairs.join(pn.withColumnRenamed("name", "a"), "polygon").join(fn.withColumnRenamed("name", "b"), "fid").withColumn("s", F.floor(similarity("a", "b")))
    scored = scored.groupBy("polygon", "level", "fid").agg(F.max("s").alias("s")).where(F.col("s") > least)
    top = scored.withColumn("r", F.rank().over(W.partitionBy("polygon", "level").orderBy(F.desc("s")))).where("r = 1")
    return best_level(top, ["polygon"], "level").groupBy("fid").agg(F.max("polygon").alias("polygon"))


def attach_polygons(features: DataFrame, polygons: DataFrame, matched: DataFrame, far: float = 0.03) -> DataFrame:
    """Features with wkb and source of their polygon, unless it neither holds the centre nor lies within ``far`` degrees."""
    given = polygons.select(F.explode("fids").alias("fid"), "polygon")
    shape = polygons.select("polygon", "wkb", "source").dropDuplicates(["polygon"])
    best = best_polygons(given, matched).join(shape, "polygon").select("fid", "wkb", "source")

    @F.pandas_udf(T.BooleanType())
    def near(wkb: pd.Series, lat: pd.Series, lng: pd.Series) -> pd.Series:
        import numpy as np

        def one(b, y, x):
            if b is None:
                return False
            p = geo.shape_of(b)
            if geo.contains(p, [x], [y])[0]:
                return True
            best = float("inf")
            for rings in p:
                for r in rings:
                    a, d = r, np.roll(r, -1, axis=0) - r
                    n = np.maximum((d * d).sum(axis=1), 1e-300)
                    t = np.clip(((np.array([x, y]) - a) * d).sum(axis=1) / n, 0, 1)
                    best = min(best, float(np.hypot(*(a + t[:, None] * d - np.array([x, y])).T).min()))
            return best <= far

        return pd.Series([one(*z) for z in zip(wkb, lat, lng)], dtype=bool)

    out = features.join(best, "fid", "left").withColumn("ok", near("wkb", "lat", "lng"))
    return out.withColumn("wkb", F.when(F.col("ok"), F.col("wkb"))).withColumn("source", F.when(F.col("ok"), F.col("source"))).withColumn("has_poly", F.col("has_poly") | F.col("ok")).drop("ok")


def features_of_unmatched(polygons: DataFrame, matched: DataFrame) -> DataFrame:
    """New features for polygons with a name and one type that nothing matched, at the middle of their box; ids are ad hoc."""
    rest = polygons.where((F.size("fids") == 0) & (F.size("names") > 0) & (F.size("levels") == 1) & (F.size(F.get("levels", F.lit(0))) == 1)).join(matched.select("polygon").distinct(), "polygon", "left_anti")

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def middle(wkb: pd.Series) -> pd.Series:
        import numpy as np

        def one(b: bytes) -> list[float] | None:
            rings = [r for p in geo.shape_of(b) for r in p if len(r)]
            a = np.concatenate(rings) if rings else None
            return ((a.min(axis=0) + a.max(axis=0)) / 2).tolist() if rings else None

        return pd.Series([one(b) for b in wkb])

    at = middle("wkb")
    return rest.withColumn("at", at).where("at IS NOT NULL").select(((F.lit(3 << 56)) + F.col("polygon")).alias("fid"), F.get("names", F.lit(0))["name"].alias("name"), F.get(F.get("levels", F.lit(0)), F.lit(0)).alias("woe"), F.get("at", F.lit(1)).alias("lat"), F.get("at", F.lit(0)).alias("lng"), "wkb")
