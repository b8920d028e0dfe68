"""Golden requests over small hand-made gazetteers."""

import pytest

from atlasweave import schema as S
from atlasweave.plans.geocode import Store, different, geocode, parse_requests

NS = 1 << 56


def store(spark, *places):
    """(name, woe, lat, lng, population, cc, parents by name)."""
    ids = {p[0] + str(i): NS + i for i, p in enumerate(places)}
    first = {}
    for i, p in enumerate(places):
        first.setdefault(p[0], NS + i)
    rows = [(NS + i, p[5], p[1], float(p[2]), float(p[3]), p[4], 0, [first[x] if isinstance(x, str) else NS + x for x in p[6]], [], False, True) for i, p in enumerate(places)]
    names = [(NS + i, p[0], "en", S.PREFERRED, 0) for i, p in enumerate(places)]
    assert len(ids) == len(places)
    return Store.of(spark.createDataFrame(rows, S.FEATURES), spark.createDataFrame(names, S.NAMES + ", pos int"))


def ask(spark, st, query, **kw):
    row = (1, query, kw.get("cc"), kw.get("lang", "en"), kw.get("lat"), kw.get("lng"), kw.get("woe_hint"), kw.get("n"))
    return geocode(spark.createDataFrame([row], S.REQUESTS), st, restrict=kw.get("restrict")).orderBy("rank").collect()


@pytest.fixture(scope="module")
def rego(spark):
    return store(spark, ("US", S.COUNTRY, 1, 2, 0, "US", []), ("New York", S.ADMIN1, 3, 4, 0, "US", ["US"]), ("Rego Park", S.TOWN, 5, 6, 500012, "US", ["New York", "US"]))


def test_split_and_score(spark, rego):
    r = ask(spark, rego, "Pizza Rego Park, New York")[0]
    assert (r["what"], r["where"], r["display_name"], r["score"]) == ("pizza", "rego park new york", "Rego Park, New York, US", 490002)


def test_country_in_request_is_not_shown(spark, rego):
    assert ask(spark, rego, "Rego Park", cc="US")[0]["display_name"] == "Rego Park, New York"


def test_admin_before_city_is_not_one_parse(spark, rego):
    r = ask(spark, rego, "New York Rego Park")[0]
    assert r["where"] == "rego park" and r["what"] == "new york"


def test_no_match(spark, rego):
    assert answers(geocode(options(spark, "nowhere at all", "", "http rego park"), rego), 3) == [[], [], []]


def test_connector(spark, rego):
    r = ask(spark, rego, "pizza near rego park")[0]
    assert (r["what"], r["where"]) == ("pizza", "rego park")
    assert ask(spark, rego, "rego park near pizza") == []


def test_common_words(spark, rego):
    assert ask(spark, rego, "rego park city new york")[0]["where"] == "rego park new york"


def test_hierarchies_do_not_cross_and_population_orders(spark):
    st = store(
        spark, ("US", S.COUNTRY, 1, 2, 0, "US", []), ("Texas", S.ADMIN1, 3, 4, 0, "US", ["US"]), ("Illinois", S.ADMIN1, 3, 4, 0, "US", ["US"]), ("Paris", S.TOWN, 5, 6, 20000, "US", [1, 0]), ("FR", S.COUNTRY, 50, 60, 0, "FR", []),
        ("IDF", S.ADMIN1, 50, 60, 0, "FR", ["FR"]), ("Paris", S.TOWN, 50, 60, 1000000, "FR", ["IDF", "FR"]), ("Paris", S.TOWN, 2, 6, 20000, "US", [2, 0]),
    )
    one = {"max_interpretations": None}
    got = answers(geocode(options(spark, ("paris", {"max_interpretations": 3}), ("paris texas", one), ("paris texas FR", one), ("paris", {**one, "lat": 5.0, "lng": 6.0})), st), 4)
    assert [[r["fid"] - NS for r in g] for g in got] == [[6, 3, 7], [3], [], [3]]  # one small token of three is too weak a parse


def test_hint_and_restriction(spark):
    st = store(spark, ("US", S.COUNTRY, 1, 2, 0, "US", []), ("Brooklyn", S.ADMIN2, 5, 6, 2504700, "US", [0]), ("Brooklyn", S.TOWN, 5, 6, 2300664, "US", [0]))
    got = answers(geocode(options(spark, ("brooklyn", {"woe_hint": [S.TOWN]}), ("brooklyn", {"woe_hint": [S.ADMIN2]})), st), 2)
    assert [g[0]["fid"] - NS for g in got] == [2, 1]
    assert ask(spark, st, "brooklyn", restrict=f"feats[0].woe = {S.TOWN}")[0]["fid"] - NS == 2


def test_completion(spark, rego):
    from atlasweave.plans.autocomplete import autocomplete

    st = store(
        spark, ("US", S.COUNTRY, 1, 2, 0, "US", []), ("New York", S.ADMIN1, 3, 4, 0, "US", ["US"]), ("Rego Park", S.TOWN, 5, 6, 500012, "US", ["New York", "US"]), ("Rego", S.TOWN, 15, 16, 5, "US", ["US"]),
        ("Regina", S.TOWN, 50, 60, 900, "CA", []),
    )
    ask_ = [(1, "reg", "US", "en"), (2, "rego park n", None, "en"), (3, "zzz", None, "en"), (4, "rego p", None, "en"), (5, "reg", "CA", "en")]
    df = spark.createDataFrame([(*r, None, None, None, None) for r in ask_], S.REQUESTS)
    got = {}
    for r in autocomplete(df, st).orderBy("qid", "rank").collect():
        got.setdefault(r["qid"], []).append((r["fid"] - NS, r["display_name"]))
    assert [f for f, _ in got[1]] == [2, 3, 4] and got[2] == [(2, "Rego Park, New York, US")] and 3 not in got and got[4] == [(2, "Rego Park, New York, US")]
    assert got[5][0][0] == 4
    one = autocomplete(df.where("qid = 1"), st, "global").orderBy("rank").collect()
    assert one[0]["fid"] - NS == 2


def options(spark, *asked):
    """Requests with any of the optional columns, numbered from 1: a query, or a query and columns."""
    from pyspark.sql import types as T

    kinds = {**{c.split()[0]: c.split()[1] for c in S.REQUESTS.split(", ")}, **S.REQUEST_OPTIONS}
    rows = [{"qid": k, "query": a if isinstance(a, str) else a[0], "lang": "en", "max_interpretations": 5, **({} if isinstance(a, str) else a[1])} for k, a in enumerate(asked, 1)]
    return spark.createDataFrame([tuple(r.get(c) for c in kinds) for r in rows], T.StructType.fromDDL(", ".join(f"`{c}` {t}" for c, t in kinds.items())))


def answers(df, n):
    """The places of each of n requests, in order."""
    out = [[] for _ in range(n)]
    for r in sorted(df.collect(), key=lambda r: (r["qid"], r["rank"])):
        out[r["qid"] - 1].append(r)
    return out


BOX = dict(zip(("south", "west", "north", "east"), (4.0, 5.0, 6.0, 7.0)))


def test_places_of_one_name_side_by_side_are_one(spark):
    st = store(spark, ("US", S.COUNTRY, 1, 2, 0, "US", []), ("New York", S.ADMIN1, 3, 4, 0, "US", ["US"]), ("Soho", S.TOWN, 5, 6, 500012, "US", ["New York", "US"]), ("Soho", S.TOWN, 5.001, 6.001, 500012, "US", ["New York", "US"]), ("Soho", S.TOWN, 25, 6, 10, "US", ["New York", "US"]))
    got = ask(spark, st, "Soho", n=3)
    assert [r["fid"] - NS for r in got] == [2, 4] and [x - NS for x in got[0]["merged"]] == [2, 3] and got[0]["display_name"] == "Soho, New York, US"


def test_the_more_specific_of_two_stays(spark):
    st = store(spark, ("US", S.COUNTRY, 1, 2, 0, "US", []), ("Brooklyn", S.ADMIN2, 40.65, -73.94, 2504700, "US", ["US"]), ("Brooklyn", S.TOWN, 40.66, -73.95, 2300664, "US", ["US"]))
    got = answers(geocode(options(spark, "Brooklyn", ("Brooklyn", {"woe_hint": [S.ADMIN2]})), st), 2)
    assert [[r["fid"] - NS for r in g] for g in got] == [[2], [1]]


def test_filters_of_a_request(spark):
    st = store(spark, ("US", S.COUNTRY, 1, 2, 0, "US", []), ("Paris", S.TOWN, 5, 6, 20000, "US", ["US"]), ("Paris", S.ADMIN2, 15, 6, 90000, "US", ["US"]), ("FR", S.COUNTRY, 1, 2, 0, "FR", []), ("Paris", S.TOWN, 50, 60, 10**6, "FR", ["FR"]))
    wide = dict(zip(("south", "west", "north", "east"), (4.0, 5.0, 16.0, 30.0)))
    small = {k: v / 10 + 4.5 for k, v in BOX.items()} | {"west": 5.5, "east": 6.5}
    cases = [
        ({}, {1, 2, 4}), ({"woe_restrict": [S.ADMIN2]}, {2}), ({"allowed_sources": ["tgn"]}, set()), ({"allowed_sources": ["geonameid"]}, {1, 2, 4}), ({"strict": True, "cc": "US"}, {1, 2}), ({"strict": True, "bounds": BOX}, {1}),
        ({"strict": True, "lat": 15.01, "lng": 6.0, "radius": 9000.0}, {2}), ({"strict": True, "lat": 50.0, "lng": 60.0}, {4}), ({"bounds": wide, "max_interpretations": 1}, {4}), ({"bounds": small, "max_interpretations": 1}, {1}),
    ]
    got = answers(geocode(options(spark, *(("Paris", c) for c, _ in cases)), st), len(cases))
    assert [{r["fid"] - NS for r in g} for g in got] == [want for _, want in cases]


def test_places_of_a_dependent_country(spark):
    st = store(spark, ("US", S.COUNTRY, 1, 2, 0, "US", []), ("San Juan", S.TOWN, 18, -66, 400000, "PR", []), ("Ponce", S.TOWN, 18, -67, 400000, "PR", []))
    got = ask(spark, st, "San Juan, US")
    assert got[0]["fid"] == NS + 1 and got[0]["where"] == "san juan us"


def test_edited_store(spark):
    st = store(spark, ("US", S.COUNTRY, 1, 2, 0, "US", []), ("Old Name", S.TOWN, 5, 6, 9, "US", ["US"]), ("Gone", S.TOWN, 5, 6, 9, "US", ["US"]))
    new = spark.createDataFrame([(NS + 1, "US", S.TOWN, 5.0, 6.0, 10, 0, [NS], [], False, True), (NS + 9, "US", S.TOWN, 7.0, 7.0, 1, 0, [NS], [], False, True)], S.FEATURES)
    names = spark.createDataFrame([(NS + 1, "New Name", "en", S.PREFERRED, 0), (NS + 9, "Added", "en", S.PREFERRED, 0)], S.NAMES + ", pos int")
    st = st.with_edits(new, spark.createDataFrame([(NS + 2,)], "fid bigint"), names).written()
    got = answers(geocode(options(spark, "Old Name", "New Name", "Added", "Gone"), st), 4)
    assert [[r["fid"] - NS for r in g] for g in got] == [[], [1], [9], []]


def test_dispatch_and_pruning(spark):
    from atlasweave.plans import requests as rq
    from atlasweave.session import cut

    st = store(spark, ("US", S.COUNTRY, 1, 2, 0, "US", []), ("New York", S.ADMIN1, 3, 4, 0, "US", ["US"]), ("Rego Park", S.TOWN, 5, 6, 500012, "US", ["New York", "US"]))
    asked = options(spark, "rego park", ("rego", {"autocomplete": True}), ("x", {"slug": "rego-park"}), ("x", {"slug": "geonameid:2"}), ("x", {"slug": "nothing"}), ("rego", {"autocomplete": True, "bias": "global", "includes": ["PARENTS", "ALL_NAMES"]}))
    mapping = spark.createDataFrame([("rego-park", NS + 2)], "key string, fid bigint")
    found = cut(rq.dispatch(asked, st, mapping))
    assert {r["qid"]: (r["mode"], r["fid"] - NS) for r in found.collect()} == {1: ("geocode", 2), 2: ("autocomplete", 2), 3: ("slug", 2), 4: ("slug", 2), 6: ("autocomplete", 2)}
    more = Store.of(st.features, st.names.unionByName(spark.createDataFrame([(NS + 2, "Parque Rego", "es", 0, 1), (NS + 2, "RP", "xx", S.ABBREVIATION, 2)], S.NAMES + ", pos int")))
    pruned = {r["qid"]: r for r in rq.prune(found, asked, more).collect()}
    assert [n["name"] for n in pruned[1]["names"]] == ["Rego Park", "RP"] and pruned[1]["parents"] is None
    assert [n["name"] for n in pruned[6]["names"]] == ["Rego Park", "Parque Rego", "RP"] and [p - NS for p in pruned[6]["parents"]] == [1, 0]


def test_requests_that_are_odd(spark):
    from atlasweave.plans import requests as rq

    rows = [(1, "query=a%20b&query=second&ll=x,2&radius=many&woeHint=7,,TOWN,999"), (2, ""), (3, None), (4, "%zz=1&query"), (5, "ll=1&lang=fr")]
    got = {r["qid"]: r for r in rq.parse_parameters(spark.createDataFrame(rows, "qid bigint, parameters string")).collect()}
    assert got[1]["query"] == "a b" and got[1]["lat"] is None and got[1]["lng"] == 2 and got[1]["radius"] is None and got[1]["woe_hint"] == [7, 7]
    assert got[2]["query"] is None and got[3]["lang"] == "en" and got[4]["query"] == "" and got[5]["lang"] == "fr" and got[5]["lat"] is None
    json = {r["qid"]: r for r in rq.parse_json(spark.createDataFrame([(1, "{bad"), (2, '{"query": "x", "woeHint": [7, "ADMIN1", "NO"]}')], "qid bigint, json string")).collect()}
    assert json[1]["query"] is None and json[2]["woe_hint"] == [7, 8]


def complete(spark, st, *asked):
    from atlasweave.plans.autocomplete import autocomplete

    return [[(r["fid"] - NS, r["highlighted_name"]) for r in g] for g in answers(autocomplete(options(spark, *asked), st), len(asked))]


def test_completion_by_prefix_and_space(spark):
    st = store(spark, ("US", S.COUNTRY, 1, 2, 0, "US", []), ("New York", S.ADMIN1, 3, 4, 0, "US", ["US"]), ("Rego Park", S.TOWN, 5, 6, 500012, "US", ["New York", "US"]), ("Rego", S.TOWN, 15, 6, 0, "US", ["US"]), ("Regoville", S.TOWN, 25, 6, 0, "US", ["US"]))
    a, b, c, d = complete(spark, st, "Rego", "Rego P", "Rego ", "Rego Park New")
    assert set(a) == {(2, "<b>Rego</b> Park, New York, US"), (3, "<b>Rego</b>, US"), (4, "<b>Rego</b>ville, US")}
    assert b == [(2, "<b>Rego P</b>ark, New York, US")] and {f for f, _ in c} == {2, 3} and [f for f, _ in d] == [2]


def test_completion_in_languages_of_the_first_name(spark):
    st = store(spark, ("US", S.COUNTRY, 1, 2, 0, "US", []), ("New York", S.ADMIN1, 3, 4, 0, "US", ["US"]), ("Queens", S.TOWN, 5, 6, 9, "US", ["New York", "US"]), ("PR Town", S.TOWN, 15, 6, 9, "PR", []))
    more = spark.createDataFrame([(NS + 2, "Reinas", "es", S.PREFERRED, 1), (NS + 1, "Nueva York", "es", S.PREFERRED, 1), (NS + 1, "Nowy Jork", "pl", S.PREFERRED, 2), (NS + 2, "Krolowe", "pl", 0, 3)], S.NAMES + ", pos int")
    st = Store.of(st.features, st.names.unionByName(more))
    got = complete(spark, st, "reinas nueva", "reinas nowy", ("reinas nowy", {"lang": "pl"}), "queens new y", "krolowe", "pr town us")
    assert [[f for f, _ in g] for g in got] == [[2], [], [2], [2], [], [3]]


def test_matched_and_alike_names(spark):
    st = store(spark, ("US", S.COUNTRY, 1, 2, 0, "US", []), ("Ohio", S.ADMIN1, 3, 4, 0, "US", ["US"]), ("Adams", S.ADMIN2, 3, 4, 0, "US", ["Ohio", "US"]), ("Brown", S.ADMIN2, 3, 4, 0, "US", ["Ohio", "US"]), ("Greenville", S.TOWN, 5, 6, 9, "US", ["Adams", "Ohio", "US"]), ("Greenville", S.TOWN, 8, 6, 8, "US", ["Brown", "Ohio", "US"]), ("L.A.", S.TOWN, 12, 13, 9, "US", ["US"]))
    st = Store.of(st.features, st.names.unionByName(spark.createDataFrame([(NS + 4, "Verteville", "fr", S.PREFERRED, 1)], S.NAMES + ", pos int")))
    a, [b], [c] = answers(geocode(options(spark, "Greenville", "verteville", "LA"), st), 3)
    assert [r["display_name"] for r in a] == ["Greenville, Adams, Ohio, US", "Greenville, Brown, Ohio, US"]
    assert (b["name"], b["matched_name"], b["highlighted_name"]) == ("Greenville", "Verteville", "<b>Verteville</b>, Ohio, US") and c["highlighted_name"] == "<b>L.A.</b>, US"


def test_requests_alike_are_answered_once(spark, rego):
    asked = options(spark, "Pizza Rego Park", "pizza, rego park", *["Rego Park"] * 20, ("Rego Park", {"cc": "US"}), ("Rego Park", {"woe_restrict": [S.ADMIN1]}))
    assert sorted(r["qid"] for r in different(parse_requests(asked))[0].collect()) == [1, 3, 23, 24]
    got = answers(geocode(asked, rego), 24)
    assert [[r["display_name"] for r in g] for g in got] == [["Rego Park, New York, US"]] * 22 + [["Rego Park, New York"], []]
    assert [g[0]["what"] for g in got[:22]] == ["pizza"] * 2 + [""] * 20


def test_filters_of_requests_alike(spark):
    st = store(spark, ("US", S.COUNTRY, 1, 2, 0, "US", []), ("Paris", S.TOWN, 5, 6, 20000, "US", ["US"]), ("Paris", S.ADMIN2, 15, 6, 90000, "US", ["US"]))
    cases = [({}, {1, 2}), ({"woe_restrict": [S.ADMIN2]}, {2}), ({"allowed_sources": ["tgn"]}, set()), ({"strict": True, "bounds": BOX}, {1}), ({"lat": 5.0, "lng": 6.0, "max_interpretations": 1}, {1}), ({"lang": "fr"}, {1, 2})]
    asked = options(spark, *(("Paris", c) for c, _ in cases * 3))
    parsed, each = different(parse_requests(asked))
    assert parsed.count() == len(cases) and {(r["first"], r["qid"]) for r in each.collect()} == {(k % len(cases) + 1, k + 1) for k in range(3 * len(cases))}
    got = answers(geocode(asked, st), 3 * len(cases))
    assert [{r["fid"] - NS for r in g} for g in got] == [want for _, want in cases] * 3


def test_large_sides_are_not_broadcast(spark):
    from pyspark.sql import functions as F

    from atlasweave.plans import gazetteer
    from atlasweave.session import BROADCAST_ROWS, cut

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    alike = lambda n: cut(spark.range(n).select((F.col("id") % 2).alias("k"), F.lit("one").alias("text")))
    assert "BroadcastHashJoin" not in plan(alike(BROADCAST_ROWS + 1).join(alike(BROADCAST_ROWS + 2).withColumnRenamed("text", "other"), "k"))
    assert "BroadcastHashJoin" in plan(alike(BROADCAST_ROWS + 1).join(F.broadcast(alike(10)).withColumnRenamed("text", "other"), "k"))
    for towns in gazetteer.sources(spark, "/root/testdata/sf0.001")[2:]:
        assert "rightHint=(strategy=broadcast)" in towns._jdf.queryExecution().optimizedPlan().toString()


def test_merging_many_places_of_one_name(spark):
    import random

    from pyspark.sql import functions as F

    from atlasweave.plans.geocode import feat, merge_same_places
    from atlasweave.session import with_columns

    dice = random.Random(5)
    n = 3000
    spots = [(dice.randrange(-20, 20) / 10 + 0.05, dice.randrange(-20, 20) / 10 + 0.05) for _ in range(n)]
    features = spark.createDataFrame([(NS + k, "US", S.TOWN, y, x, k, 0, [], [], False, True) for k, (y, x) in enumerate(spots)], S.FEATURES)
    labels = spark.createDataFrame([(NS + k, [("Twin" if k % 2 else "Other", "en", 1)]) for k in range(n)], "fid bigint, names array<struct<name:string,lang:string,flags:int>>")
    rows = with_columns(features, S.FEATURE_OPTIONS).withColumn("langs", F.array(F.lit("en"))).withColumn("flags", F.array(F.lit(1))).withColumn("start", F.lit(0)).withColumn("end", F.lit(1))
    rows = rows.select(F.lit(1).cast("bigint").alias("qid"), (F.col("population") + 1).cast("int").alias("rank"), "fid", F.array(feat()).alias("feats"), F.lit(None).cast("array<int>").alias("woe_hint"))
    merged = merge_same_places(rows, labels)
    assert "collect_list(struct(rank" not in merged._jdf.queryExecution().optimizedPlan().toString()  # no row holds all places of its name
    got = sorted((r["rank"], r["fid"] - NS, [f - NS for f in r["merged"]]) for r in merged.collect())
    want, taken = [], {0: {}, 1: {}}
    for k, (y, x) in enumerate(spots):
        y, x, opened = int(y / 0.15), int(x / 0.15), taken[k % 2]
        own = next(((y + a, x + b) for a in (0, -1, 1) for b in (0, -1, 1) if (y + a, x + b) in opened), (y, x))
        opened.setdefault(own, []).append(k)
    want = sorted(m for opened in taken.values() for m in opened.values())
    assert got == [(i, m[0], m) for i, m in enumerate(want, 1)]
