"""Names of places expanded to what people write, and candidate slugs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasweave import schema as S
from atlasweave.functions import names as N
from atlasweave.operators.enrich import merge_names, shadow_deaccented

# Templates of slugs in order of preference, and the countries they are for.
SLUG_PATTERNS = [
    ("{COUNTRY}", []),
    ("{COUNTRY}/{ADMIN1}", ["US", "CA"]),
    ("{COUNTRY}/{ADMIN1}", []),
    ("{FEATURE}-{ADMIN1}", ["US", "CA"]),
    ("{FEATURE}-{ADMIN1}-{COUNTRY}", ["US", "CA"]),
    ("{FEATURE}-{COUNTRY}", []),
    ("{FEATURE}-{ADMIN1}-{COUNTRY}", []),
    ("{FEATURE}-{ADMIN2}-{ADMIN1}-{COUNTRY}", []),
    ("{FEATURE}-{ADMIN3}-{ADMIN1}-{COUNTRY}", []),
    ("{FEATURE}-{ADMIN3}-{ADMIN2}-{ADMIN1}-{COUNTRY}", []),
    ("{FEATURE}-{TOWN}-{ADMIN1}-{COUNTRY}", []),
    ("{FEATURE}-{TOWN}-{ADMIN2}-{ADMIN1}-{COUNTRY}", []),
    ("{FEATURE}-{TOWN}-{ADMIN3}-{ADMIN1}-{COUNTRY}", []),
    ("{FEATURE}-{TOWN}-{ADMIN3}-{ADMIN2}-{ADMIN1}-{COUNTRY}", []),
]
TYPES = {"COUNTRY": S.COUNTRY, "ADMIN1": S.ADMIN1, "ADMIN2": S.ADMIN2, "ADMIN3": S.ADMIN3, "TOWN": S.TOWN}


def expand_names(names: DataFrame, features: DataFrame, rules: dict, languages: DataFrame | None = None) -> DataFrame:
    """(fid, name, lang, flags) with shortened, deaccented, rewritten and local variants, merged.

    Names of language post vanish, abbr makes an abbreviation, names in a language of ``languages`` (cc, languages) are
    local. Variants carry SHORT_NAME, DEACCENT or ALIAS; a deaccented name that another name equals is dropped, and of
    Japan and Thailand the hyphenated twin of an English name in title case.
    """
    rows = names.where("lang <> 'post'").join(features.select("fid", "cc", "woe"), "fid")
    if languages is not None:
        rows = rows.join(languages.select("cc", F.col("languages").alias("spoken")), "cc", "left")
    else:
        rows = rows.withColumn("spoken", F.lit(None).cast("array<string>"))
    flags = F.col("flags").bitwiseOR(F.when(F.col("lang") == "abbr", S.ABBREVIATION).otherwise(0))
    flags = flags.bitwiseOR(F.when(F.array_contains("spoken", F.col("lang")), S.LOCAL_LANG).otherwise(0))
    name = F.when(F.col("lang") == "ro", N.romanian(F.col("name"))).otherwise(F.col("name"))
    rows = rows.select("fid", "cc", "woe", "lang", name.alias("name"), flags.alias("flags")).withColumn("plain", N.deaccent("name"))
    n, cc, own = F.col("name"), F.col("cc"), F.col("flags")
    made = lambda x, f: F.struct(x.alias("name"), own.bitwiseOR(F.lit(f)).alias("flags"))
    less = N.apply_deletes(n, rules["deletes"]) if rules.get("deletes") else n
    many = F.array_distinct(F.concat(N.apply_rewrites(n, rules.get("rewrites", [])), N.apply_rewrites(less, rules.get("rewrites", []))))
    short = N.shortest(n, cc, rules["shortens"]) if rules.get("shortens") else F.lit(None).cast("string")
    hack = N.country_hack(n, cc, F.col("woe"))
    extra = F.array(F.struct(n.alias("name"), own.alias("flags")), F.when(short.isNotNull(), made(short, S.SHORT_NAME)), F.when(F.col("plain") != n, made(F.col("plain"), S.DEACCENT)), F.when(hack.isNotNull(), made(hack, S.ALIAS)))
    alias = F.transform(F.filter(many, lambda x: (x != n) & (x != "")), lambda x: made(x, S.ALIAS))
    out = rows.select("fid", "cc", "lang", F.explode(F.filter(F.concat(extra, alias), lambda x: x.isNotNull())).alias("x")).select("fid", "cc", "lang", "x.name", "x.flags")
    title = F.col("name").contains(" ") & F.forall(F.split("name", " "), lambda w: w.rlike(r"^\p{Lu}"))
    twin = F.concat_ws("-", F.substring_index("name", " ", 1), F.regexp_replace(F.lower(F.expr("substring(name, instr(name, ' ') + 1)")), " ", "-"))
    bad = out.where(F.col("cc").isin("JP", "TH") & (F.col("lang") == "en") & title).select("fid", twin.alias("name")).distinct()
    out = out.join(bad, ["fid", "name"], "left_anti").select("fid", "name", "lang", "flags")
    return shadow_deaccented(merge_names(out))


def slug_candidates(df: DataFrame) -> DataFrame:
    """(fid, cc, woe, name, kin: array of (woe, name), nearest first) to (fid, option, slug): the templates that the place and
    its kin fill, normalised, each once. A template without the place's own name needs the place among its types."""

    def text(pattern: str, ccs: list[str]) -> Column:
        general = "{FEATURE}" in pattern
        out = F.replace(F.lit(pattern), F.lit("{FEATURE}"), F.col("name"))
        used = F.lit(general)
        for token, woe in TYPES.items():
            if f"{{{token}}}" in pattern:
                found = F.get(F.transform(F.filter("kin", _of(woe)), lambda k: k["name"]), F.lit(0))
                own = F.when(F.col("woe") == woe, F.col("name"))
                out = F.replace(out, F.lit(f"{{{token}}}"), found if general else F.coalesce(found, own))
                used = used | (found.isNull() & own.isNotNull())
        return F.when(used & (F.col("cc").isin(ccs) if ccs else F.lit(True)), out)

    made = F.array(*(text(p, c) for p, c in SLUG_PATTERNS))
    rows = df.select("fid", F.posexplode(F.array_distinct(F.filter(made, lambda x: x.isNotNull()))).alias("option", "slug"))
    return rows.withColumn("slug", N.slug(F.col("slug"))).groupBy("fid", "slug").agg(F.min("option").alias("option")).select("fid", "option", "slug")


def _of(woe: int):
    return lambda k: k["woe"] == woe
