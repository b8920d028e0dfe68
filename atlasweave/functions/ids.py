"""Feature ids, postal ids and slugs as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from atlasweave.schema import NAMESPACE_QUALITY, NAMESPACES, ZIP_ALPHABET, ZIP_COUNTRIES

LOW = (1 << 56) - 1


def feature_id(namespace: Column | int, local: Column) -> Column:
    """The top 8 bits hold the namespace, the low 56 the id within it."""
    ns = F.lit(namespace) if isinstance(namespace, int) else namespace
    return F.shiftleft(ns.cast("bigint"), 56).bitwiseOR(local.cast("bigint").bitwiseAND(F.lit(LOW)))


def namespace_of(fid: Column) -> Column:
    return F.shiftright(fid, 56).cast("int")


def namespace_name(fid: Column) -> Column:
    """The name of an id's namespace, null for others."""
    out = F.lit(None).cast("string")
    for name, code in NAMESPACES.items():
        out = F.when(namespace_of(fid) == code, name).otherwise(out)
    return out


def local_of(fid: Column) -> Column:
    return fid.bitwiseAND(F.lit(LOW))


def namespace_order(fid: Column) -> Column:
    """Position in the list of namespaces by quality, -1 for others."""
    out = F.lit(-1)
    for i, n in enumerate(NAMESPACE_QUALITY):
        out = F.when(namespace_of(fid) == NAMESPACES[n], i).otherwise(out)
    return out


def parse_id(text: Column, default: str | None = None) -> Column:
    """A decimal long, ``namespace:id``, or with a default namespace a bare local id; null if it is none of these."""
    ns = F.split(text, ":", 2)
    known = F.lit(None).cast("int")
    for name, code in NAMESPACES.items():
        known = F.when(ns[0] == name, code).otherwise(known)
    long = text.try_cast("bigint")
    named = F.when(text.contains(":") & known.isNotNull(), feature_id(known, F.get(ns, F.lit(1)).try_cast("bigint")))
    bare = feature_id(NAMESPACES[default], long) if default else long
    return F.when(text.rlike("^-?[0-9]+$"), bare).otherwise(named)


def postal_id(cc: Column, code: Column) -> Column:
    """A postal code packed in base 38 under the number of its country; null if it can't be packed (over 9 characters,
    a character outside the alphabet, an unknown country). Long French codes are shortened first."""
    number = F.array_position(F.array(*map(F.lit, ZIP_COUNTRIES)), cc) - 1
    french = (
        F.when(code.contains("CEDEX"), F.regexp_replace(code, " CEDEX ?", "CE"))
        .when(code.contains(" SP "), F.replace(code, F.lit(" SP "), F.lit("SP")))
        .when(code.contains("CITYSSIMO"), F.replace(code, F.lit(" CITYSSIMO"), F.lit("CI")))
        .otherwise(code)
    )
    short = F.when(cc == "FR", french).otherwise(code)
    value = F.aggregate(F.filter(F.split(short, ""), lambda c: c != ""), F.lit(0).cast("bigint"), lambda a, c: a * 38 + F.instr(F.lit(ZIP_ALPHABET), c) - 1)
    fits = (number >= 0) & (F.length(short) <= 9) & short.rlike("^[0-9A-Z -]*$")
    return F.when(fits, F.shiftleft(number.cast("bigint"), 48) + value)


def postal_parts(local: Column) -> Column:
    """The struct (cc, code) of a packed postal id. Leading zeros are the digits of value 0, so they aren't restored."""
    cc = F.element_at(F.array(*map(F.lit, ZIP_COUNTRIES)), (F.shiftright(local, 48).bitwiseAND(F.lit(255)) + 1).cast("int"))
    rest = local.bitwiseAND(F.lit((1 << 48) - 1))
    digits = F.transform(F.sequence(F.lit(8), F.lit(0), F.lit(-1)), lambda i: F.floor(rest / F.pow(F.lit(38.0), i)).cast("bigint") % 38)
    size = F.aggregate(F.sequence(F.lit(0), F.lit(8)), F.lit(0), lambda a, i: F.when(F.floor(rest / F.pow(F.lit(38.0), i)) > 0, i + 1).otherwise(a))
    text = F.array_join(F.transform(F.slice(digits, 10 - size, F.greatest(size, F.lit(1))), lambda d: F.substring(F.lit(ZIP_ALPHABET), (d + 1).cast("int"), F.lit(1))), "")
    code = F.when(size == 0, F.lit("")).otherwise(text)
    french = (
        F.when(code.endswith("CE"), F.replace(code, F.lit("CE"), F.lit(" CEDEX")))
        .when(code.contains("CE"), F.replace(code, F.lit("CE"), F.lit(" CEDEX ")))
        .when(code.contains("SP"), F.replace(code, F.lit("SP"), F.lit(" SP ")))
        .when(code.contains("CI"), F.replace(code, F.lit("CI"), F.lit(" CITYSSIMO")))
        .otherwise(code)
    )
    return F.when(local.isNotNull(), F.struct(cc.alias("cc"), F.when(cc == "FR", french).otherwise(code).alias("code")))
