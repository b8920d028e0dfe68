"""Joins, merges and edits that turn sources into features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from atlasweave import schema as S
from atlasweave.functions.geo import wkb_of_text


def union_first(sources: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """Union of all; of rows with one key, the first in the given total order."""
    rows = reduce(DataFrame.unionByName, sources)
    keep = [F.col(c) for c in rows.columns if c != key]
    best = F.min_by(F.struct(*keep), F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)]))
    return rows.groupBy(key).agg(best.alias("#")).select(key, *(F.col("#")[c].alias(c) for c in rows.columns if c != key))


def sum_boosts(boosts: DataFrame, key: str = "fid") -> DataFrame:
    """(key, boost): the sum of all boosts of a place."""
    return boosts.groupBy(key).agg(F.sum("boost").alias("boost"))


def join_boosts(features: DataFrame, boosts: DataFrame) -> DataFrame:
    """(fid, boost) rows are summed and replace a feature's own boost."""
    total = sum_boosts(boosts).withColumnRenamed("boost", "new")
    return features.join(total, "fid", "left").withColumn("boost", F.coalesce("new", "boost")).drop("new")


def join_boxes(features: DataFrame, boxes: DataFrame) -> DataFrame:
    """(fid, box) of the right replaces the left's where present."""
    return features.join(boxes.select("fid", F.col("box").alias("new")), "fid", "left").withColumn("box", F.coalesce("new", "box") if "box" in features.columns else F.col("new")).drop("new")


def join_parents(features: DataFrame, relations: DataFrame) -> DataFrame:
    """(fid, parent) rows follow the own parents, without repeats; added ones in order of their ids."""
    more = relations.groupBy("fid").agg(F.array_sort(F.collect_set("parent")).alias("new"))
    return features.join(more, "fid", "left").withColumn("parents", F.array_distinct(F.concat("parents", F.coalesce("new", F.array().cast("array<bigint>"))))).drop("new")


def join_extras(features: DataFrame, relations: DataFrame) -> DataFrame:
    """(fid, extra) rows replace the own extra relations."""
    more = relations.groupBy("fid").agg(F.array_sort(F.collect_set("extra")).alias("new"))
    return features.join(more, "fid", "left").withColumn("extras", F.coalesce("new", "extras")).drop("new")


def join_concordances(features: DataFrame, relations: DataFrame) -> DataFrame:
    """(fid, other) ids are appended to ids, with repeats, in order."""
    more = relations.groupBy("fid").agg(F.array_sort(F.collect_list("other")).alias("new"))
    return features.join(more, "fid", "left").withColumn("ids", F.concat(F.array("fid"), F.coalesce("new", F.array().cast("array<bigint>")))).drop("new")


def join_slugs(features: DataFrame, slugs: DataFrame) -> DataFrame:
    """(fid, slug, score, deprecated): all slugs, current and best ones first, and the first as display slug."""
    more = slugs.groupBy("fid").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("deprecated").alias("d"), (-F.col("score")).alias("s"), F.col("slug").alias("slug")))), lambda x: x["slug"]).alias("slugs"))
    return features.join(more, "fid", "left").withColumn("slug", F.get("slugs", F.lit(0)))


def join_attributes(features: DataFrame, attributes: DataFrame, fields: list[str]) -> DataFrame:
    """First row of attributes a feature (by all fields); each present field replaces the own."""
    first = attributes.groupBy("fid").agg(F.min(F.struct(*fields)).alias("new"))
    out = features.join(first, "fid", "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col("new")[f], F.col(f)) if f in features.columns else F.col("new")[f])
    return out.drop("new")


def classify(cls: Column, code: Column) -> Column:
    """Place type of a gazetteer class and code; the first rule that holds."""
    return (
        F.when(code.contains("ISL"), S.ISLAND).when(code.contains("PPLX"), S.SUBURB).when(code == "CONT", S.CONTINENT).when(code == "PRK", S.PARK)
        .when(cls == "S", S.POI).when(code.contains("PCL"), S.COUNTRY).when(cls == "Z", S.POSTAL_CODE).when(code.contains("PPL") | (cls == "P"), S.TOWN)
        .when(code.startswith("AIR"), S.AIRPORT).when(code == "ADM1", S.ADMIN1).when(code == "ADM2", S.ADMIN2).when(code.isin("ADM3", "ADM4", "ADMD"), S.ADMIN3).otherwise(S.UNKNOWN)
    )


def should_index(cls: Column, code: Column, name: Column, cc: Column, buildings: bool = False) -> Column:
    """Whether a gazetteer row becomes a feature."""
    dropped = code.isin("RGNE", "PPLQ", "WLL", "WLLS", "WLLQ")
    dropped = dropped | ((cc == "US") & (code == "ADMD") & name.startswith("City of"))
    dropped = dropped | ((cc == "DE") & name.endswith(", Stadt"))
    return ~dropped if buildings else ~dropped & (cls != "S")


def admin_path(cc: Column, codes: list[Column], level: Column) -> Column:
    """The dotted codes of every level from the country down to the own (0 is the country)."""
    return F.array_join(F.slice(F.array(cc, *codes), 1, level + 1), ".")


def admin_parents(cc: Column, codes: list[Column], level: Column) -> Column:
    """Paths of the strictly higher levels, without those that end in .00."""
    all_codes = F.array(cc, *codes)
    paths = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), level)), lambda i: F.array_join(F.slice(all_codes, 1, i), "."))
    return F.when(level > 0, F.filter(paths, lambda p: ~p.endswith(".00"))).otherwise(F.array().cast("array<string>"))


def merge_names(names: DataFrame) -> DataFrame:
    """One row a (fid, lang, name): flags united; ALIAS goes if several rows met and one hadn't it."""
    out = names.groupBy("fid", "lang", "name").agg(F.bit_or("flags").alias("flags"), F.count("*").alias("n"), F.bool_and(F.col("flags").bitwiseAND(F.lit(S.ALIAS)) != 0).alias("all_alias"))
    keeps = (F.col("n") == 1) | F.col("all_alias")
    return out.select("fid", "lang", "name", F.when(keeps, F.col("flags")).otherwise(F.col("flags").bitwiseAND(F.lit(~S.ALIAS))).alias("flags"))


def promote_primary(names: DataFrame, alternates: DataFrame, features: DataFrame, countries: DataFrame | None = None) -> DataFrame:
    """(fid, name, lang, flags): the own names of places and their alternate names, with the primary name as an English one.

    The primary name (English and PREFERRED) is left out if an alternate English PREFERRED name equals it; it stays PREFERRED if
    the place has no alternate English name, or none that is PREFERRED but an equal plain one; else it loses the flag. Places
    without alternate names keep theirs. ``countries`` (cc, name) adds a country's name, PREFERRED and COLLOQUIAL.
    """
    names, alternates = names.select("fid", "name", "lang", "flags"), alternates.select("fid", "name", "lang", "flags")
    preferred = lambda c: c.bitwiseAND(F.lit(S.PREFERRED)) != 0
    english = alternates.where("lang = 'en'").groupBy("fid").agg(F.collect_set(F.when(preferred(F.col("flags")), F.col("name"))).alias("best"), F.collect_set(F.when(~preferred(F.col("flags")), F.col("name"))).alias("plain"))
    has = alternates.groupBy("fid").agg(F.lit(True).alias("#has"))
    rows = names.join(english, "fid", "left").join(has, "fid", "left")
    primary = (F.col("lang") == "en") & preferred(F.col("flags")) & F.coalesce(F.col("#has"), F.lit(False))
    none = F.coalesce(F.size("best"), F.lit(0)) + F.coalesce(F.size("plain"), F.lit(0)) <= 0
    same = F.coalesce(F.array_contains("best", F.col("name")), F.lit(False))
    stays = none | (F.size("best") == 0) & F.array_contains("plain", F.col("name"))
    flags = F.when(primary & ~F.coalesce(stays, F.lit(False)), F.col("flags").bitwiseAND(F.lit(~S.PREFERRED))).otherwise(F.col("flags"))
    out = rows.where(~(primary & same)).select("fid", "name", "lang", flags.alias("flags")).unionByName(alternates)
    if countries is not None:
        named = features.where(F.col("woe") == S.COUNTRY).join(countries.select("cc", "name"), "cc").join(has, "fid", "left_semi")
        out = out.unionByName(named.select("fid", "name", F.lit("en").alias("lang"), F.lit(S.PREFERRED | S.COLLOQUIAL).alias("flags")))
    return out


def shadow_deaccented(names: DataFrame) -> DataFrame:
    """Drops deaccented names that equal another name of the place and language."""
    plain = names.where(F.col("flags").bitwiseAND(F.lit(S.DEACCENT)) == 0).select("fid", "lang", "name").distinct()
    accents = names.where(F.col("flags").bitwiseAND(F.lit(S.DEACCENT)) != 0)
    return names.where(F.col("flags").bitwiseAND(F.lit(S.DEACCENT)) == 0).unionByName(accents.join(plain, ["fid", "lang", "name"], "left_anti"))


def best_polygons(prematched: DataFrame, matched: DataFrame) -> DataFrame:
    """(fid, polygon) of both; the larger polygon id wins within and between them."""
    a = prematched.groupBy("fid").agg(F.max("polygon").alias("pa"))
    b = matched.groupBy("fid").agg(F.max("polygon").alias("pb"))
    return a.join(b, "fid", "full_outer").select("fid", F.greatest("pa", "pb").alias("polygon"))


def best_level(matches: DataFrame, by: list[str], level: str) -> DataFrame:
    """Rows at the smallest level of their group; ties stay."""
    return matches.withColumn("#", F.min(level).over(W.partitionBy(*by))).where(F.col(level) == F.col("#")).drop("#")


def list_edit(values: Column, kind: Column, value: Column) -> Column:
    """One edit of a list: Add removes and appends, Remove removes, anything else leaves it."""
    less = F.filter(F.coalesce(values, F.array(value)), lambda x: ~x.eqNullSafe(value))
    return F.when(kind == "Add", F.concat(less, F.array(value))).when(kind == "Remove", less).otherwise(values)


LISTS = {"parents": "parents_edits", "extras": "extras_edits", "urls": "urls_edits"}


def apply_edits(features: DataFrame, edits: DataFrame) -> DataFrame:
    """Edits (fid, seq, kind, fields): any Remove drops the feature; of the Modify ones the last of each field holds.

    Fields are any columns that both tables have; a struct is merged field by field. parents_edits, extras_edits and urls_edits
    (arrays of kind and value) edit those lists in the order of seq. geometry, well-known text or GeoJSON, replaces wkb
    (with has_poly and source), and an empty one removes it; one that can't be read changes nothing. Adds concern overlays
    and are ignored here, as is any other kind.
    """
    fields = [c for c in edits.columns if c in features.columns and c not in ("fid", "seq", "kind")]
    lists = [c for c, e in LISTS.items() if c in features.columns and e in edits.columns]
    shaped = "geometry" in edits.columns and "wkb" in features.columns
    own = F.col("kind") == "Modify"
    last = lambda c: F.max_by(c, F.when(own & F.col(c).isNotNull(), F.col("seq")))
    parts = {c: f.dataType.names if isinstance((f := features.schema[c]).dataType, T.StructType) else None for c in fields}
    picks = [F.bool_or(F.col("kind") == "Remove").alias("gone")]
    for c, names in parts.items():
        flat = [f"{c}.{n}" for n in names] if names else [c]
        picks += [F.max_by(F.col(x), F.when(own & F.col(x).isNotNull(), F.col("seq"))).alias(f"new_{x}") for x in flat]
    picks += [F.array_sort(F.collect_list(F.when(own & F.col(LISTS[c]).isNotNull(), F.struct("seq", F.col(LISTS[c]).alias("e"))))).alias(f"new_{c}") for c in lists]
    if shaped:
        picks.append(last("geometry").alias("new_geometry"))
    per = edits.groupBy("fid").agg(*picks)
    out = features.join(per, "fid", "left").where("NOT coalesce(gone, false)")
    for c, names in parts.items():
        if names:
            merged = F.struct(*(F.coalesce(F.col(f"`new_{c}.{n}`"), F.col(c)[n]).alias(n) for n in names))
            some = F.coalesce(*(F.col(f"`new_{c}.{n}`").cast("string") for n in names)).isNotNull() | F.col(c).isNotNull()
            out = out.withColumn(c, F.when(some, merged))
        else:
            out = out.withColumn(c, F.coalesce(f"new_{c}", c))
    for c in lists:
        steps = F.flatten(F.transform(F.coalesce(f"new_{c}", F.array()), lambda x: x["e"]))
        kind = dict(features.dtypes)[c]
        out = out.withColumn(c, F.when(F.size(f"new_{c}") > 0, F.aggregate(steps, F.coalesce(F.col(c), F.array().cast(kind)), lambda a, e: list_edit(a, e["kind"], e["value"]))).otherwise(F.col(c)))
    if shaped:
        text = F.col("new_geometry")
        out = out.withColumn("new_wkb", wkb_of_text(text)).withColumn("is_new", F.col("new_wkb").isNotNull())
        removed = F.coalesce(F.trim(text) == "", F.lit(False))
        out = out.withColumn("wkb", F.when(removed, F.lit(None)).when(F.col("is_new"), F.col("new_wkb")).otherwise(F.col("wkb")))
        for c, value in (("has_poly", F.lit(True)), ("source", F.lit("index-build-override"))):
            if c in features.columns:
                out = out.withColumn(c, F.when(removed, F.lit(False) if c == "has_poly" else F.col(c)).when(F.col("is_new"), value).otherwise(F.col(c)))
    return out.select(*features.columns)


def edit_names(names: Column, kind: Column, name: Column, lang: Column, flags: Column) -> Column:
    """One edit of an array of (name, lang, flags): Add removes and appends (a PREFERRED one takes that flag from others of
    its language), Remove drops (language * drops all), Modify changes flags where present."""
    same = lambda n: (n["name"] == name) & ((lang == "*") | (n["lang"] == lang))
    made = F.struct(name.alias("name"), lang.alias("lang"), flags.alias("flags"))
    calm = lambda n: F.when((n["lang"] == lang) & (flags.bitwiseAND(F.lit(S.PREFERRED)) != 0), F.struct(n["name"].alias("name"), n["lang"].alias("lang"), n["flags"].bitwiseAND(F.lit(~S.PREFERRED)).alias("flags"))).otherwise(F.struct(n["name"].alias("name"), n["lang"].alias("lang"), n["flags"].alias("flags")))
    rest = F.filter(names, lambda n: ~same(n))
    return F.when(kind == "Add", F.concat(F.transform(rest, calm), F.array(made))).when(kind == "Remove", rest).otherwise(F.transform(names, lambda n: F.when(same(n), made).otherwise(calm(n))))


def overlay(base: DataFrame, changed: DataFrame, deleted: DataFrame, key: str = "fid") -> DataFrame:
    """Base without changed rows, plus these, without deleted ones."""
    return base.join(changed.select(key), key, "left_anti").unionByName(changed).join(deleted.select(key), key, "left_anti")
