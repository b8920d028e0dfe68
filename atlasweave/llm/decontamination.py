"""Benchmark decontamination by template canonicalisation, in DataFrame expressions only.

Texts become template tokens: numbers, names (capitalised words inside a sentence) and units (a unit word after a number)
are replaced by typed placeholders, all else is lower-cased. Windows of ``WINDOW`` template tokens of the benchmark, with
at least ``LITERALS`` literal ones, are hash-joined with the windows of all documents. Matches on one diagonal (document
position less item position) are aligned, so each slot of the item meets the value the document has there. A diagonal is
consistent if the same item value of a type always meets the same document value, and different names meet different
values: a question with its parameters replaced passes, mere likeness of form doesn't. A document is contaminated by an
item if consistent diagonals cover ``COVERAGE`` percent of the item's windows, or ``RUN`` windows.

An item without a window of enough literal tokens, or of fewer than ``SHORT`` tokens, can't be told from others by its
template. Its windows of lower-cased raw tokens are matched instead: such an item is found as a copy, under the same shares.

The first word of an item is literal, since nothing is before it; the same word inside a line of a document is a name or a
unit. So a document's window that begins with a name or unit leaves a second hash, with that word taken literally.

The benchmark's windows are broadcast after they were counted; beyond ``BROADCAST_WINDOWS`` they are joined by a shuffle.
Only a hash and a position leave a document for each window; slot values are fetched for matched documents alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from atlasweave.llm._spark import keep_ids, written
from atlasweave.llm.quality_rules import _let

WINDOW, LITERALS, COVERAGE, RUN = 8, 5, 50, 30
SHORT = 4  # items with fewer template tokens than this are too short to be told apart by templates: only copies match
BROADCAST_WINDOWS = 1_000_000

# Words that are units after a number.
UNITS = ["mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yd", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "kilogram", "kilograms", "lb", "lbs", "pound", "pounds", "oz", "ounce", "ounces", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hr", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "percent", "dollar", "dollars", "cent", "cents", "euro", "euros", "usd", "eur", "mph", "kmh", "hz", "khz", "mhz", "ghz", "w", "kw", "mw", "v", "kb", "mb", "gb", "tb", "degree", "degrees", "meter", "meters", "metre", "metres", "kilometer", "kilometers", "kilometre", "kilometres", "centimeter", "centimeters"]

_END = "\x01"  # stands for the end of a sentence or line while names are told
NUMBER, NAME, UNIT = "\x02number", "\x02name", "\x02unit"


def raw_tokens(text: Column) -> Column:
    """Letters-and-digits tokens with ends of sentences; numbers lose their separators."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"([0-9])[.,]([0-9])", "$1$2")
    t = F.regexp_replace(t, r"[.!?:]+\s|\n", f" {_END} ")
    return F.filter(F.split(t, rf"[^\p{{L}}\p{{M}}\p{{N}}{_END}]+"), lambda w: w != "")


def template_tokens(raw: Column) -> Column:
    """Structs (t, v) without the ends of sentences: the template token and the lower-cased word."""

    def of(a: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            low, before = F.lower(w), F.get(a, i - 1)
            first = F.left(w, F.lit(1))
            digit = first.between("0", "9")
            kind = F.when(digit & w.rlike(r"^[0-9]+$"), NUMBER)
            kind = kind.when((first != F.left(low, F.lit(1))) & (i > 0) & (before != _END), NAME)
            kind = kind.when((F.length(w) <= 11) & F.left(before, F.lit(1)).between("0", "9") & low.isin(UNITS), UNIT)
            return F.when(w != _END, F.struct(kind.otherwise(low).alias("t"), low.alias("v")))

        return F.filter(F.transform(a, one), lambda x: x.isNotNull())

    return _let(raw, of)


def _windows(hashes: Column, width: int) -> Column:
    """Hashes of all windows of the hashed tokens; none if there are fewer than the width."""
    return _let(hashes, lambda h: F.when(F.size(h) >= width, F.transform(F.sequence(F.lit(1), F.size(h) - (width - 1)), lambda i: F.xxhash64(F.slice(h, i, width)))).otherwise(F.array().cast("array<bigint>")))


def _hashes(field: str) -> Column:
    return F.transform(F.col("tokens"), lambda x: F.xxhash64(x[field]))


def _own_window(width: int, literal):
    need = min(LITERALS, width)
    return lambda h, i: F.struct(F.lit(width).alias("width"), F.when(F.size(F.filter(F.slice(F.col("tokens"), i + 1, width), literal)) >= need, h).alias("h"), i.alias("ipos"))


def _copied_window(width: int):
    """A window of raw tokens; its width is negative, so it never meets a template window."""
    return lambda h, i: F.struct(F.lit(-width).alias("width"), h.alias("h"), i.alias("ipos"))


def _their_window(width: int):
    return lambda h, i: F.struct(F.lit(width).alias("width"), h.alias("h"), i.alias("dpos"))


def _their_first(width: int) -> Column:
    """Windows of the document that begin with a name or unit, once more with that word literal."""
    tokens = F.col("tokens")
    at = F.filter(F.transform(tokens, lambda x, i: F.when(x["t"].isin(NAME, UNIT), i)), lambda i: i.isNotNull())

    def of(h: Column) -> Column:
        first = lambda i: F.xxhash64(F.concat(F.array(F.xxhash64(F.get(tokens, i)["v"])), F.slice(h, i + 2, width - 1)))
        return F.transform(F.filter(at, lambda i: i + width <= F.size(h)), lambda i: F.struct(F.lit(width).alias("width"), first(i).alias("h"), i.alias("dpos")))

    return _let(_hashes("t"), of)


def _own_keys(items: DataFrame, widths: list[int]) -> DataFrame:
    """item_id, width, h, ipos: template windows of the items that have an accepted one, else raw windows."""
    literal = lambda x: ~F.startswith(x["t"], F.lit("\x02"))
    template, copied = F.lit(None), F.lit(None)
    for w in widths:
        here = (F.size("tokens") == w) if w < WINDOW else (F.size("tokens") >= w)
        if w >= SHORT:
            template = F.when(here, F.filter(F.transform(_windows(_hashes("t"), w), _own_window(w, literal)), lambda x: x["h"].isNotNull())).otherwise(template)
        copied = F.when(here, F.transform(_windows(_hashes("v"), w), _copied_window(w))).otherwise(copied)
    if widths[-1] < SHORT:
        mine = copied
    else:
        mine = _let(template, lambda x: F.when(F.size(x) > 0, x).otherwise(copied))
    return items.select("item_id", F.explode(mine).alias("x")).select("item_id", "x.*")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_windows, item_windows, n_slots, n_changed for each contaminating pair, each once.

    n_windows counts different windows of the item found on consistent diagonals; n_slots the slots met there, n_changed
    those whose value differs. Null or empty texts, texts without a token and null ids match nothing; repeated rows give
    one row a pair; items shorter than a window are one window of their own length; items that can't be told by their
    template (fewer than 4 tokens, or too few literal ones in every window) match copies alone; an empty table on either
    side gives no rows; other columns are ignored. Whole texts are searched.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL").dropDuplicates(["item_id", "text"])
    items = written(items.select("item_id", template_tokens(raw_tokens(F.col("text"))).alias("tokens")).where(F.size("tokens") > 0), "items")
    widths = sorted(r["w"] for r in items.select(F.least(F.size("tokens"), F.lit(WINDOW)).alias("w")).distinct().collect()) or [WINDOW]  # at most WINDOW
    keys = written(_own_keys(items, widths), "windows")
    if keys.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        small = F.broadcast(keys)
    else:
        small = keys
    used = sorted(r["width"] for r in keys.select("width").distinct().collect()) or [WINDOW]  # at most 2 * WINDOW
    each = F.concat(*(F.transform(_windows(_hashes("t" if w > 0 else "v"), abs(w)), _their_window(w)) for w in used), *(_their_first(w) for w in used if w > 0))
    tokens = docs.select("doc_id", template_tokens(raw_tokens(F.col("text"))).alias("tokens"))
    found = tokens.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*").join(small, ["width", "h"])
    hits = written(found.select("doc_id", "item_id", (F.col("dpos") - F.col("ipos")).alias("diagonal"), "ipos", F.abs("width").alias("width"), (F.col("width") < 0).alias("copied")).distinct(), "hits")
    line = ["doc_id", "item_id", "copied", "diagonal"]
    lines = hits.groupBy(*line).agg(F.min("ipos").alias("lo"), F.max(F.col("ipos") + F.col("width")).alias("hi"))
    # slots of matched documents and of items, aligned by the diagonal
    slots = lambda df, key: df.select(key, F.posexplode("tokens").alias("pos", "x")).select(key, "pos", "x.t", "x.v").where(F.startswith("t", F.lit("\x02")))
    theirs = slots(keep_ids(docs, hits, "doc_id").select("doc_id", template_tokens(raw_tokens(F.col("text"))).alias("tokens")), "doc_id").distinct()
    ours = written(slots(items, "item_id").distinct(), "slots")
    if ours.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS:
        ours = F.broadcast(ours)  # an item that very many documents hold isn't one task's
    met = lines.join(ours, "item_id").where("pos >= lo AND pos < hi").withColumn("dpos", F.col("pos") + F.col("diagonal"))
    met = met.join(theirs.select("doc_id", F.col("pos").alias("dpos"), F.col("t").alias("dt"), F.col("v").alias("dv")), ["doc_id", "dpos"]).where("t = dt")
    pairs = met.groupBy(*line, "t", "v", "dv").agg(F.count("*").alias("n"))
    forth = pairs.groupBy(*line, "t", "v").agg(F.count("*").alias("values"), F.sum("n").alias("n"), F.sum(F.when(F.col("v") != F.col("dv"), F.col("n")).otherwise(0)).alias("changed"))
    forth = forth.groupBy(*line).agg(F.max("values").alias("values"), F.sum("n").alias("slots"), F.sum("changed").alias("changed"))
    back = pairs.where(F.col("t") == NAME).groupBy(*line, "dv").agg(F.count("*").alias("names")).groupBy(*line).agg(F.max("names").alias("names"))
    judged = lines.select(*line).join(forth, line, "left").join(back, line, "left").where("copied OR coalesce(values, 1) = 1 AND coalesce(names, 1) = 1")
    per_line = hits.join(judged, line)
    pair = ["doc_id", "item_id", "copied"]
    windows = per_line.groupBy(*pair).agg(F.countDistinct("ipos").alias("n_windows"))
    changed = judged.groupBy(*pair).agg(F.coalesce(F.sum("slots"), F.lit(0)).alias("n_slots"), F.coalesce(F.sum("changed"), F.lit(0)).alias("n_changed"))
    sizes = keys.groupBy("item_id", (F.col("width") < 0).alias("copied")).agg(F.countDistinct("ipos").alias("item_windows"))
    out = windows.join(changed, pair).join(F.broadcast(sizes) if small is not keys else sizes, ["item_id", "copied"])
    out = out.where((F.col("n_windows") * 100 >= F.col("item_windows") * COVERAGE) | (F.col("n_windows") >= RUN))
    # an id that repeats with texts of both kinds still gives one row a pair
    best = F.max(F.struct("n_windows", "item_windows", "n_slots", "n_changed")).alias("x")
    return out.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.*")


def op6_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, also with its parameters replaced."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
