"""A gazetteer derived from the star-schema tables, so that every operator has rows to work on at any scale.

Regions are countries, nations first-level divisions, customers and suppliers towns, parts suburbs (even keys) or points of
interest. Each place's coordinates follow from its key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasweave import schema as S
from atlasweave.functions.ids import feature_id
from atlasweave.session import small


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lat(k: Column) -> Column:
    return (k.cast("bigint") * 37 % 1600) / 10.0 - 80


def _lng(k: Column) -> Column:
    return (k.cast("bigint") * 73 % 3600) / 10.0 - 180


def sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    """One DataFrame per source with the columns of schema.FEATURES and name, key, priority."""
    region, nation, customer, supplier, part = (table(spark, sf_dir, t) for t in "region nation customer supplier part".split())
    per_nation = customer.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("population"))
    nations = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    counted = nations.join(per_nation, "n_nationkey", "left").withColumn("population", F.coalesce("population", F.lit(0).cast("bigint")))
    cc = F.substring("r_name", 1, 2)
    region_fid, nation_fid = feature_id(4, F.col("r_regionkey")), feature_id(1, F.col("n_nationkey"))

    def rows(df: DataFrame, fid: Column, woe: Column | int, key: Column, population: Column, parents: list[Column], name: Column, priority: int) -> DataFrame:
        kin = F.array(*parents) if parents else F.array().cast("array<bigint>")
        return df.select(
            fid.alias("fid"), cc.alias("cc"), (F.lit(woe) if isinstance(woe, int) else woe).cast("int").alias("woe"), _lat(key).alias("lat"), _lng(key).alias("lng"), population.cast("bigint").alias("population"), F.lit(0).cast("bigint").alias("boost"),
            kin.alias("parents"), F.array().cast("array<bigint>").alias("extras"), F.lit(False).alias("has_poly"), F.lit(True).alias("can_geocode"), name.alias("name"), key.cast("bigint").alias("key"), F.lit(priority).alias("priority"),
        )

    by_region = counted.groupBy("r_regionkey", "r_name").agg(F.sum("population").alias("population"))
    kin = [nation_fid, region_fid]
    # a join is taken for as large as the product of its sides: without the count the towns would be broadcast to it
    at = small(nations.select("n_nationkey", "n_name", "r_regionkey", "r_name"))
    money = lambda c: F.floor(F.abs(F.col(c)) * 10)
    parts = part.withColumn("n_nationkey", (F.col("p_partkey") % 25).cast("int")).join(at, "n_nationkey")
    return [
        rows(by_region, region_fid, S.COUNTRY, F.col("r_regionkey"), F.col("population"), [], F.col("r_name"), 0),
        rows(counted, nation_fid, S.ADMIN1, F.col("n_nationkey"), F.col("population"), [region_fid], F.col("n_name"), 1),
        rows(customer.join(at, F.col("c_nationkey") == F.col("n_nationkey")), feature_id(3, F.col("c_custkey")), S.TOWN, F.col("c_custkey"), money("c_acctbal"), kin, F.col("c_name"), 2),
        rows(supplier.join(at, F.col("s_nationkey") == F.col("n_nationkey")), feature_id(5, F.col("s_suppkey")), S.TOWN, F.col("s_suppkey"), money("s_acctbal"), kin, F.col("s_name"), 3),
        rows(parts, feature_id(6, F.col("p_partkey")), F.when(F.col("p_partkey") % 2 == 0, S.SUBURB).otherwise(S.POI), F.col("p_partkey"), F.floor("p_retailprice"), kin, F.col("p_name"), 4),
    ]


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources; ids can't repeat between them."""
    return reduce(DataFrame.unionByName, sources(spark, sf_dir))


def names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fid, name, lang, flags, pos): the own name first; countries are abbreviated, parts have their brand as an abbreviation."""
    own = features(spark, sf_dir).select("fid", "name", F.lit("en").alias("lang"), F.lit(S.PREFERRED).alias("flags"), F.lit(0).alias("pos"))
    region, part = table(spark, sf_dir, "region"), table(spark, sf_dir, "part")
    short = region.select(feature_id(4, F.col("r_regionkey")).alias("fid"), F.substring("r_name", 1, 2).alias("name"), F.lit("abbr").alias("lang"), F.lit(S.ABBREVIATION).alias("flags"), F.lit(1).alias("pos"))
    brand = part.select(feature_id(6, F.col("p_partkey")).alias("fid"), F.col("p_brand").alias("name"), F.lit("abbr").alias("lang"), F.lit(S.ABBREVIATION).alias("flags"), F.lit(1).alias("pos"))
    return own.unionByName(short).unionByName(brand)
