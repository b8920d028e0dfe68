"""From import files to a store: one wide plan of left joins in place of a chain of jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from atlasweave import schema as S
from atlasweave.functions import geo, ids
from atlasweave.functions.ids import parse_id
from atlasweave.functions.names import best_name
from atlasweave.operators import enrich, indexes, polygons
from atlasweave.operators.expand import expand_names, slug_candidates
from atlasweave.plans.geocode import Store
from atlasweave.plans.reverse import CellIndex, cell_index, coverings, repair_parents
from atlasweave.session import cut
from atlasweave.sources import readers as R
from atlasweave.sources.sinks import write_index


def _features(df: DataFrame, priority: int) -> DataFrame:
    none = lambda t: F.lit(None).cast(t)
    have = set(df.columns)
    col = lambda c, t, default: (F.coalesce(F.col(c), default) if c in have else default).cast(t).alias(c)
    empty = F.array().cast("array<bigint>")
    return df.select("fid", col("cc", "string", F.lit("XX")), F.col("woe").cast("int").alias("woe"), "lat", "lng", col("population", "bigint", F.lit(0)), col("boost", "bigint", F.lit(0)), col("parents", "array<bigint>", empty), empty.alias("extras"), F.lit(False).alias("has_poly"), col("can_geocode", "boolean", F.lit(True)), geo.wkb_of_text(col("geometry", "string", none("string"))).alias("wkb"), _box(col("bbox", "string", none("string"))).alias("box"), none("string").alias("source"), F.lit(priority).alias("priority"))


def _box(text):
    """west, south, east, north by comma, as bounds."""
    p = F.split(text, ",")
    at = lambda i: F.trim(F.get(p, F.lit(i))).try_cast("double")
    box = F.struct(at(1).alias("south"), at(0).alias("west"), at(3).alias("north"), at(2).alias("east"))
    return F.when((F.size(p) == 4) & at(0).isNotNull() & at(1).isNotNull() & at(2).isNotNull() & at(3).isNotNull(), box)


def build(spark: SparkSession, files: dict[str, list[str]]) -> tuple[Store, CellIndex]:
    """(store, polygon cell index) of the files by kind; kinds that aren't given are empty.

    Kinds: places, buildings, postal, getty, names, hierarchy, relations, concordances, boosts, boxes, attributes, slugs, ignores,
    moves, deletes_of_names, transforms, polygons, admin, countries, rewrites, shortens, deletes. Earlier sources win where ids
    repeat. A polygon of the polygon files goes before one that a place carries itself. The store's features have bounds,
    whether they are world cities, and other ids; slugs are kept in ``Store.slugs``.
    """
    at = lambda k: files.get(k, [])
    main, buildings, postal, getty = R.gazetteer(spark, at("places")), R.gazetteer(spark, at("buildings"), True), R.postal_codes(spark, at("postal")), R.getty(spark, at("getty"))
    sources = [_features(d, i) for i, d in enumerate([main, buildings, postal, getty])]
    features = enrich.union_first(sources, "fid", [F.col("priority"), F.col("lat"), F.col("lng")]).drop("priority")
    # parents by code, by hierarchy files; boosts, relations
    codes = main.unionByName(buildings).select("fid", "cc", "admin", F.when(F.col("woe") == S.COUNTRY, 0).when(F.col("woe") == S.ADMIN1, 1).when(F.col("woe") == S.ADMIN2, 2).when(F.col("woe") == S.ADMIN3, 3).otherwise(5).alias("level"))
    codes = codes.select("fid", F.explode(enrich.admin_parents(F.col("cc"), [F.get("admin", F.lit(i)) for i in range(4)], F.col("level"))).alias("path"))
    known = R.admin_codes(spark, at("admin")).select("path", F.col("fid").alias("parent")).unionByName(R.countries(spark, at("countries")).select(F.col("cc").alias("path"), F.col("fid").alias("parent")))
    parents = codes.join(known, "path").where("fid <> parent").select("fid", "parent").unionByName(R.hierarchy(spark, at("hierarchy")))
    features = enrich.join_extras(enrich.join_parents(enrich.join_boosts(features, R.boosts(spark, at("boosts"))), parents), R.relations(spark, at("relations")).withColumnRenamed("other", "extra"))
    boxes = R.boxes(spark, at("boxes")).groupBy("fid").agg(F.min(F.struct("south", "west", "north", "east")).alias("box"))
    features = enrich.join_boxes(features, boxes)
    features = enrich.join_attributes(features, R.attributes(spark, at("attributes")), ["worldcity"]).withColumn("world_city", F.coalesce(F.col("worldcity") == 1, F.lit(False))).drop("worldcity")
    others = R.relations(spark, at("concordances"))
    features = enrich.join_concordances(features, others).withColumn("other_ids", F.transform(F.slice("ids", 2, F.size("ids")), lambda x: F.concat_ws(":", ids.namespace_name(x), ids.local_of(x).cast("string")))).drop("ids")
    # edits of places
    edits = R.edits(spark, at("ignores"), at("moves"), at("deletes_of_names"), at("transforms"))
    features = cut(enrich.apply_edits(features, edits.select("fid", "seq", "kind", F.lit(None).cast("bigint").alias("population"), "lat", "lng")), "features")
    # names: own and alternate, expanded, then edited
    own = R.embedded_names(main.unionByName(buildings)).unionByName(postal.select("fid", "name", F.lit("").alias("lang"), F.lit(S.PREFERRED).alias("flags"))).unionByName(getty.select("fid", F.explode("names").alias("n")).select("fid", "n.name", "n.lang", F.lit(S.PREFERRED).alias("flags")))
    every = enrich.promote_primary(own, R.alternate_names(spark, at("names")), features, R.countries(spark, at("countries"))).where("name <> ''")
    rules = R.rules(spark, at("rewrites"), at("shortens"), at("deletes"))
    names = expand_names(every, features, rules, R.countries(spark, at("countries")))
    names = edit_names(names, edits)
    # polygons and what they repair
    shapes = cut(R.flattened_polygons(spark, at("polygons")), "polygons")
    matched = cut(polygons.match_polygons(shapes, features, names, rules), "matched")
    attached = polygons.attach_polygons(features.drop("wkb", "source"), shapes, matched).join(features.select("fid", F.col("wkb").alias("carried")), "fid")
    features = cut(attached.withColumn("has_poly", F.col("has_poly") | F.col("carried").isNotNull()).withColumn("wkb", F.coalesce("wkb", "carried")).drop("carried"), "features")
    index = cell_index(features.where("wkb IS NOT NULL").select("fid", "wkb")).written()
    known_ids = features.select(F.col("fid").alias("parent"))
    flat = features.select("fid", F.posexplode("parents").alias("p", "parent")).join(known_ids, "parent", "left_semi").groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "parent"))), lambda x: x["parent"]).alias("kept"))
    features = features.join(flat, "fid", "left").withColumn("parents", F.coalesce("kept", F.array().cast("array<bigint>"))).drop("kept")
    features = repair_parents(features, index)
    order = names.withColumn("pos", F.when(F.col("flags").bitwiseAND(F.lit(S.PREFERRED)) != 0, 0).otherwise(1))
    store = Store.of(features, order)
    store.slugs = slugs_of(store, R.slugs(spark, at("slugs")))
    return store, index


def slugs_of(store: Store, known: DataFrame) -> DataFrame:
    """(fid, slug): known slugs (slug, fid, score, deprecated) that are current stay; other eligible places get one by the templates."""
    label = store.labels.select("fid", best_name(F.col("names"), F.lit("en")).alias("name"))
    parents = store.features.select("fid", F.posexplode("parents").alias("pos", "parent")).join(store.features.select(F.col("fid").alias("parent"), "woe").join(label.withColumnRenamed("fid", "parent"), "parent"), "parent")
    kin = parents.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "woe", "name"))), lambda x: F.struct(x["woe"].alias("woe"), x["name"].alias("name"))).alias("kin"))
    rows = indexes.slug_eligible(store.features).join(label, "fid").join(kin, "fid", "left").withColumn("kin", F.coalesce("kin", F.array().cast("array<struct<woe:int,name:string>>")))
    made = slug_candidates(rows.select("fid", "cc", "woe", "name", "kin")).join(rows.select("fid", (F.col("population") + F.col("boost")).alias("score")), "fid")
    return indexes.assign_slugs(made, known.where("NOT deprecated").select("slug", "fid"))


def edit_names(names: DataFrame, edits: DataFrame) -> DataFrame:
    """Names after their edits in order; places without edits pass as they are."""
    todo = edits.where("name_kind IS NOT NULL").groupBy("fid").agg(F.array_sort(F.collect_list(F.struct("seq", "name_kind", "name", "lang", "flags"))).alias("todo"))
    one = names.join(todo, "fid").groupBy("fid").agg(F.first("todo").alias("todo"), F.array_sort(F.collect_list(F.struct("name", "lang", "flags"))).alias("names"))
    folded = F.aggregate("todo", F.col("names"), lambda a, e: enrich.edit_names(a, e["name_kind"], e["name"], e["lang"], e["flags"]))
    changed = one.select("fid", F.explode(folded).alias("n")).select("fid", "n.name", "n.lang", "n.flags")
    return names.join(todo.select("fid"), "fid", "left_anti").select("fid", "name", "lang", "flags").unionByName(changed)



def write_indexes(store: Store, index: CellIndex, path: str, replace: bool = False) -> list[str]:
    """Writes all lookup tables of a store below a folder, each sorted by its key; returns their names.

    features, names (normal name to places), prefixes, ids (slugs and other ids to places), polygons, cells (of reverse
    geocoding), coverings and interiors (cells of each polygon). Without ``replace`` those that are there stay.
    """
    mapping = indexes.id_mapping(store.features, store.slugs if store.slugs is not None else store.features.select(F.lit("").alias("slug"), "fid").limit(0), store.features.select(F.explode("other_ids").alias("o"), "fid").select(parse_id(F.col("o")).alias("other"), "fid").where("other IS NOT NULL"))
    tables = {
        "features": (store.features, "fid"), "names": (indexes.name_index(store.names, store.features), "name"), "prefixes": (indexes.prefix_index(store.names, store.features), "prefix"), "ids": (mapping, "key"),
        "polygons": (index.polygons, "fid"), "cells": (index.cells, "cell"), "coverings": (coverings(index.polygons), "fid"), "interiors": (coverings(index.polygons, S.INTERIOR_LEVELS, S.INTERIOR_MAX_CELLS, interior=True), "fid"),
    }
    meta = {"cells": {"levels": ",".join(map(str, S.REVGEO_LEVELS)), "most": S.REVGEO_MAX_CELLS}}
    for name, (table, key) in tables.items():
        write_index(table, f"{path}/{name}", key, replace, meta.get(name))
    return list(tables)
