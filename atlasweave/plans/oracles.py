"""DuckDB SQL for the catalogue's queries, over the same tables."""

from __future__ import annotations

from atlasweave.functions.geo import RADIUS_METERS
from atlasweave.plans.catalog import DELETES, REWRITES
from atlasweave.schema import ZIP_ALPHABET, ZIP_COUNTRIES

GAZ = """WITH per AS (SELECT c_nationkey AS nk, count(*) AS population FROM customer GROUP BY 1),
nat AS (SELECT n_nationkey, n_name, r_regionkey, r_name, substr(r_name, 1, 2) AS cc, coalesce(per.population, 0) AS population FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN per ON nk = n_nationkey),
kin AS (SELECT *, [(1::BIGINT << 56) + n_nationkey, (4::BIGINT << 56) + r_regionkey] AS parents FROM nat),
gaz AS (
 SELECT (4::BIGINT << 56) + r_regionkey AS fid, cc, 12 AS woe, r_regionkey::BIGINT AS key, sum(population)::BIGINT AS population, []::BIGINT[] AS parents, r_name AS name, 0 AS priority FROM nat GROUP BY r_regionkey, r_name, cc
 UNION ALL SELECT (1::BIGINT << 56) + n_nationkey, cc, 8, n_nationkey::BIGINT, population::BIGINT, [(4::BIGINT << 56) + r_regionkey], n_name, 1 FROM nat
 UNION ALL SELECT (3::BIGINT << 56) + c_custkey, cc, 7, c_custkey, floor(abs(c_acctbal) * 10)::BIGINT, parents, c_name, 2 FROM customer JOIN kin ON c_nationkey = n_nationkey
 UNION ALL SELECT (5::BIGINT << 56) + s_suppkey, cc, 7, s_suppkey, floor(abs(s_acctbal) * 10)::BIGINT, parents, s_name, 3 FROM supplier JOIN kin ON s_nationkey = n_nationkey
 UNION ALL SELECT (6::BIGINT << 56) + p_partkey, cc, CASE WHEN p_partkey % 2 = 0 THEN 22 ELSE 20 END, p_partkey, floor(p_retailprice)::BIGINT, parents, p_name, 4 FROM part JOIN kin ON p_partkey % 25 = n_nationkey),
f AS (SELECT *, (key * 37 % 1600)::DOUBLE / 10 - 80 AS lat, (key * 73 % 3600)::DOUBLE / 10 - 180 AS lng FROM gaz),
nm AS (SELECT fid, name, 'en' AS lang, 1 AS flags, 0 AS pos FROM f
 UNION ALL SELECT (4::BIGINT << 56) + r_regionkey, substr(r_name, 1, 2), 'abbr', 2, 1 FROM region
 UNION ALL SELECT (6::BIGINT << 56) + p_partkey, p_brand, 'abbr', 2, 1 FROM part)"""


def _normal(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower({x}), '[''‘’.–]', '', 'g'), '[!-/:-@\\[-`{{-~\\t]', ' ', 'g'), ' +', ' ', 'g'))"


def _meters(a: str, b: str, c: str, d: str) -> str:
    return f"floor(acos(least(1.0, greatest(-1.0, sin(radians({a})) * sin(radians({c})) + cos(radians({a})) * cos(radians({c})) * cos(radians({d}) - radians({b}))))) * {RADIUS_METERS})::BIGINT"


def _miles(a: str, b: str, c: str, d: str) -> str:
    return f"7912.0 * asin(least(1.0, sqrt(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2))))"


_ROWS = f"rowsx AS (SELECT DISTINCT {_normal('nm.name')} AS name, f.fid, f.population AS score FROM nm JOIN f USING (fid) WHERE {_normal('nm.name')} <> '')"
_LIST = lambda items: "[" + ", ".join(f"'{x}'" for x in items) + "]"
_CODES = _LIST("PPL PPLX ADM1 ADM2 ADM3 ADMD PCLI AIRP ISL PRK CONT BLDG WLL RGNE XX PPLA".split())
_MADE = ", ".join(f"regexp_replace(name, '{p}', '{t}', 'g')" for p, many in REWRITES for t in many)
_CUT = "|".join(sorted(DELETES, key=lambda w: (-len(w), w)))
_ORD = "CASE woe WHEN 12 THEN 8 WHEN 8 THEN 7 WHEN 7 THEN 4 WHEN 22 THEN 3 WHEN 20 THEN 2 END"
_DIST = f"CASE WHEN m < 5000 THEN CASE WHEN woe = 22 THEN 6000000 ELSE 4000000 END WHEN m < 10000 THEN CASE WHEN woe = 22 THEN 3000000 ELSE 2000000 END WHEN m < 20000 THEN CASE WHEN woe = 22 THEN 2000000 ELSE 1000000 END WHEN m < 100000 THEN -10000 ELSE FAR END"
_REQ = """req AS (SELECT c_custkey AS qid, lower(replace(c_name, '#', ' ')) AS town, lower(replace(n_name, '_', ' ')) AS division, n_regionkey AS r, CASE WHEN c_custkey % 2 = 1 THEN ['AF', 'AM', 'AS', 'EU', 'MI'][n_regionkey + 1] END AS want FROM customer JOIN nation ON c_nationkey = n_nationkey)"""

# places of every kind, as _varied in the catalogue, and the terms of a score that all profiles share
_VARIED = """v AS (SELECT *, CASE woe WHEN 11 THEN 0 WHEN 14 THEN 1 WHEN 20 THEN 2 WHEN 22 THEN 3 WHEN 7 THEN 4 WHEN 10 THEN 5 WHEN 9 THEN 6 WHEN 8 THEN 7 WHEN 12 THEN 8 ELSE -1 END AS ord FROM
 (SELECT fid, key, CASE WHEN key % 5 = 0 THEN 'US' ELSE cc END AS cc, CASE WHEN key % 19 = 0 THEN 0 WHEN key % 17 = 0 THEN 14 WHEN key % 10 = 0 THEN 9 WHEN key % 9 = 0 THEN 11 ELSE woe END AS woe, lat, lng, population, key % 100 AS boost, key % 3 = 0 AS has_poly, key % 7 = 0 AS has_box, key % 23 = 0 AS world FROM f))"""
_BASE_ALONE = "CASE WHEN has_box OR has_poly THEN 1000 ELSE 0 END - CASE WHEN key % 13 = 0 THEN 100000000 ELSE 0 END - CASE WHEN key % 11 = 0 THEN 100000000 ELSE 0 END - 5000 + CASE WHEN cc = 'US' THEN 1 ELSE 0 END - CASE WHEN cc = 'US' AND woe = 9 THEN 30000 ELSE 0 END - CASE WHEN woe = 0 THEN 1000000000 ELSE 0 END - ord"
_BASE = _BASE_ALONE + " + CASE WHEN woe = 22 THEN 50000000 ELSE 0 END - CASE WHEN key % 29 = 0 THEN 100005000 + ord WHEN key % 2 = 0 THEN 5007 ELSE 0 END"
# (score, least) of the rankers that a completion is merged from
_RANKERS = [
    ("base + trunc(population * 0.1::DOUBLE)::BIGINT - 100000000 + hint * 10", 0), ("base", 0), ("base + population + miss", 1_000_000),
    ("base + population + trunc(hint * 0.001::DOUBLE)::BIGINT", 1_000_000), ("base + trunc(population * 0.001::DOUBLE)::BIGINT + hint * 10", 0),
]


def _rankers() -> str:
    out = ""
    for i, (score, least) in enumerate(_RANKERS):
        out += f""", s{i} AS (SELECT *, {score} AS s, grp IS NULL AND {score} >= {least} AS free FROM t{i}), o{i} AS (SELECT *, free AND row_number() OVER (PARTITION BY qid ORDER BY free DESC, s DESC, fid) = 1 AS taken FROM s{i}),
 t{i + 1} AS (SELECT qid, fid, name, hint, miss, population, base, CASE WHEN taken THEN {i} ELSE grp END AS grp, CASE WHEN taken THEN s ELSE score END AS score FROM o{i})"""
    return out


def _st(w: str) -> str:
    return f"least(1073741823, greatest(0, floor(CASE WHEN {w} >= 0 THEN 0.5::DOUBLE * sqrt(1 + 3 * abs({w})) ELSE 1 - 0.5::DOUBLE * sqrt(1 + 3 * abs({w})) END * 1073741824)))::BIGINT"


def _curve(levels: int) -> str:
    """Steps along the curve: the quarter of each level, and how the next one is turned."""
    out = ""
    for k in range(levels):
        bit = 29 - k
        out += f""", g{k} AS (SELECT *, [[0, 1, 3, 2], [0, 3, 1, 2], [2, 3, 1, 0], [2, 1, 3, 0]][turn + 1][((i >> {bit}) & 1) * 2 + ((j >> {bit}) & 1) + 1] AS q FROM h{k}), h{k + 1} AS (SELECT fid, face, i, j, pos * 4 + q AS pos, xor(turn, [1, 0, 0, 3][q + 1]) AS turn FROM g{k})"""
    return out


ORACLES = {
    "feature_union_first": GAZ + " SELECT id, fid, woe, population, priority, key FROM (SELECT *, concat(cc, '|', lower(name)) AS id, row_number() OVER (PARTITION BY cc, lower(name) ORDER BY priority, key) AS n FROM f) WHERE n = 1",
    "classify_place_type": f"""WITH p AS (SELECT p_partkey, p_name, {_CODES}[p_partkey % 16 + 1] AS code, ['P', 'A', 'S', 'Z', 'T'][p_partkey % 5 + 1] AS cls, ['US', 'DE', 'FR'][p_partkey % 3 + 1] AS cc FROM part),
 w AS (SELECT *, CASE WHEN contains(code, 'ISL') THEN 13 WHEN contains(code, 'PPLX') THEN 22 WHEN code = 'CONT' THEN 29 WHEN code = 'PRK' THEN 16 WHEN cls = 'S' THEN 20 WHEN contains(code, 'PCL') THEN 12 WHEN cls = 'Z' THEN 11 WHEN contains(code, 'PPL') OR cls = 'P' THEN 7 WHEN starts_with(code, 'AIR') THEN 14 WHEN code = 'ADM1' THEN 8 WHEN code = 'ADM2' THEN 9 WHEN code IN ('ADM3', 'ADM4', 'ADMD') THEN 10 ELSE 0 END AS woe FROM p)
 SELECT p_partkey, woe, NOT (code IN ('RGNE', 'PPLQ', 'WLL', 'WLLS', 'WLLQ') OR (cc = 'US' AND code = 'ADMD' AND starts_with(p_name, 'City of')) OR (cc = 'DE' AND ends_with(p_name, ', Stadt'))) AND cls <> 'S' AS indexed, CASE WHEN woe = 12 THEN 4 WHEN woe IN (8, 9) THEN 6 WHEN woe IN (10, 7) THEN 8 ELSE 10 END AS level FROM w""",
    "admin_code_parents": """WITH c AS (SELECT c_custkey, substr(r_name, 1, 2) AS cc, CASE WHEN n_nationkey % 5 = 0 THEN '00' ELSE n_nationkey::VARCHAR END AS a, c_custkey::VARCHAR AS b, c_custkey % 3 AS level FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
 SELECT c_custkey, CASE level WHEN 0 THEN cc WHEN 1 THEN cc || '.' || a ELSE cc || '.' || a || '.' || b END AS path, CASE level WHEN 0 THEN '' WHEN 1 THEN cc ELSE CASE WHEN a = '00' THEN cc ELSE cc || '|' || cc || '.' || a END END AS parents FROM c""",
    "enrich_left_joins": GAZ + """, b AS (SELECT (6::BIGINT << 56) + l_partkey AS fid, sum(trunc(l_quantity)::BIGINT)::BIGINT AS boost FROM lineitem WHERE trunc(l_quantity)::BIGINT > 40 GROUP BY 1),
 p AS (SELECT fid, list(parent ORDER BY parent) AS l FROM (SELECT DISTINCT (6::BIGINT << 56) + l_partkey AS fid, (5::BIGINT << 56) + l_suppkey AS parent FROM lineitem WHERE l_linenumber = 1) GROUP BY fid),
 e AS (SELECT fid, list(x ORDER BY x) AS l FROM (SELECT DISTINCT (6::BIGINT << 56) + l_partkey AS fid, (5::BIGINT << 56) + l_suppkey AS x FROM lineitem WHERE l_linenumber = 7) GROUP BY fid)
 SELECT f.fid, coalesce(b.boost, 0)::BIGINT AS boost, array_to_string(list_concat(f.parents, coalesce(p.l, [])), ',') AS parents, coalesce(array_to_string(e.l, ','), '') AS extras, s.s_nationkey::BIGINT AS box FROM f LEFT JOIN b USING (fid) LEFT JOIN p USING (fid) LEFT JOIN e USING (fid) LEFT JOIN supplier s ON (5::BIGINT << 56) + s_suppkey = f.fid""",
    "boost_sum": "SELECT l_partkey, sum(trunc(l_quantity)::BIGINT)::BIGINT AS boost FROM lineitem GROUP BY 1",
    "polygon_pick_max": "SELECT coalesce(a.c, b.c) AS fid, greatest(a.p, b.p) AS polygon FROM (SELECT o_custkey c, max(o_orderkey) p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) a FULL JOIN (SELECT o_custkey c, max(o_orderkey) p FROM orders WHERE o_orderstatus = 'O' GROUP BY 1) b ON a.c = b.c",
    "best_level_filter": "SELECT o_custkey, o_orderkey, level FROM (SELECT *, substr(o_orderpriority, 1, 1)::INT AS level, rank() OVER (PARTITION BY o_custkey ORDER BY substr(o_orderpriority, 1, 1)) AS r FROM orders) WHERE r = 1",
    "name_flag_merge": """WITH n AS (SELECT p_partkey % 25 AS fid, 'en' AS lang, p_name AS name, [1, 8, 9, 16, 4][p_partkey % 5 + 1] AS flags FROM part),
 g AS (SELECT fid, lang, name, bit_or(flags) AS flags, count(*) AS n, bool_and((flags & 8) <> 0) AS alias FROM n GROUP BY ALL), m AS (SELECT fid, lang, name, CASE WHEN n = 1 OR alias THEN flags ELSE flags & ~8 END AS flags FROM g)
 SELECT * FROM m WHERE (flags & 4) = 0 OR NOT EXISTS (SELECT 1 FROM m o WHERE o.fid = m.fid AND o.lang = m.lang AND o.name = m.name AND (o.flags & 4) = 0)""",
    "normalize_tokens": f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents UNION ALL SELECT c_custkey, c_name FROM customer), n AS (SELECT doc_id, {_normal('line')} AS n FROM l)
 SELECT doc_id, sum(len(list_filter(regexp_split_to_array(n, '[ ,]'), lambda x: x <> '')))::BIGINT AS n_tokens, max(n) AS largest, sum(length(n))::BIGINT AS chars FROM n GROUP BY doc_id""",
    "deaccent_text": "SELECT doc_id, strip_accents(lower(text)) AS plain FROM documents",
    "rewrite_shorten_delete": GAZ + f""", p AS (SELECT fid, name, cc FROM f WHERE woe IN (20, 22)), d AS (SELECT *, regexp_replace(name, '(?i)(?:{_CUT})\\b', '', 'g') AS cut FROM p),
 s AS (SELECT *, list_filter([trim(regexp_replace(name, 'widget\\b', '', 'g')), CASE WHEN cc = 'AF' THEN trim(regexp_replace(name, 'cold\\b', '', 'g')) END, CASE WHEN cc = 'AS' THEN trim(regexp_replace(name, 'hot\\b', 'h', 'g')) END, trim(regexp_replace(name, 'ring\\b', 'rg', 'g'))], lambda x: x IS NOT NULL AND x <> name AND x <> '') AS made FROM d)
 SELECT fid, array_to_string(list_sort(list_distinct([name, {_MADE}, replace(name, 'ß', 'ss')])), '|') AS rewritten, CASE WHEN cut <> name THEN trim(regexp_replace(cut, ' +', ' ', 'g')) ELSE name END AS deleted, list_sort(list_transform(made, lambda x: {{'n': length(x), 'x': x}}))[1].x AS short, name || '|' || cc AS parts FROM s""",
    "name_similarity": """WITH p AS (SELECT DISTINCT p_brand, p_name FROM part), s AS (SELECT a.p_brand, a.p_name, round(100 * jaro_winkler_similarity(replace(a.p_name, ' ', ''), replace(b.p_name, ' ', '')), 4) AS s FROM p a JOIN p b ON a.p_brand = b.p_brand AND a.p_name < b.p_name)
 SELECT p_brand, p_name, max(s) AS best, sum((s > 95)::INT)::BIGINT AS accepted FROM s GROUP BY 1, 2""",
    "name_index_build": GAZ + f", {_ROWS} SELECT name, string_agg(fid::VARCHAR, ',' ORDER BY score DESC, fid) AS fids FROM rowsx GROUP BY name",
    "prefix_index_topk": GAZ + f""", n AS (SELECT fid, {_normal('nm.name')} AS name, lang, flags, woe, population AS score FROM nm JOIN f USING (fid) WHERE woe <> 20),
 e AS (SELECT *, unnest(generate_series(1, least(5, length(name)))) AS k FROM n WHERE name <> ''), p AS (SELECT *, substr(name, 1, k) AS prefix FROM e),
 q AS (SELECT *, name = prefix AS whole FROM p WHERE name = prefix OR NOT regexp_matches(name, '^[0-9]+$')), r AS (SELECT prefix, fid, min((NOT whole)::INT) AS part, max(score) AS score, min(CASE WHEN (flags & 33) <> 0 AND (lang = 'en' OR (flags & 16) <> 0) THEN 0 WHEN lang = 'en' OR (flags & 16) <> 0 THEN 1 ELSE 2 END) AS tier FROM q WHERE whole OR k > 2 OR score > 0 GROUP BY 1, 2),
 t AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY part, score DESC, fid) AS n FROM r), u AS (SELECT *, sum((tier = 0)::INT) OVER (PARTITION BY prefix) AS good FROM t WHERE n <= 1000),
 v AS (SELECT prefix, fid, row_number() OVER (PARTITION BY prefix ORDER BY tier, n)::INT AS rank FROM u WHERE tier = 0 OR good < 3) SELECT prefix, rank, fid FROM v WHERE rank <= 50""",
    "prefix_lookup_cap": GAZ + f""", {_ROWS}, q AS (SELECT DISTINCT substr(p_name, 1, 4) AS prefix FROM part), h AS (SELECT prefix, name, fid, score FROM q JOIN rowsx ON starts_with(name, prefix)),
 i AS (SELECT *, count(*) OVER (PARTITION BY prefix) AS total, row_number() OVER (PARTITION BY prefix, name ORDER BY score DESC, fid) AS first FROM h), j AS (SELECT *, sum((first = 1)::INT) OVER (PARTITION BY prefix) AS names FROM i),
 k AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY name, score DESC, fid) AS n FROM j WHERE total <= 100 OR (names <= 1000 AND first <= greatest(1, floor(100 / names)))) SELECT prefix, name, fid FROM k WHERE n <= 100""",
    "feature_id_codec": GAZ + """ SELECT fid, (fid >> 56)::INT AS ns, fid & 72057594037927935 AS local, CASE fid >> 56 WHEN 5 THEN 0 WHEN 4 THEN 1 WHEN 3 THEN 2 WHEN 1 THEN 3 WHEN 0 THEN 4 WHEN 6 THEN 5 ELSE -1 END AS quality, (1::BIGINT << 56) + (fid & 72057594037927935) AS parsed, fid AS long_id FROM f""",
    "postal_id_codec": f"""WITH c AS (SELECT c_custkey, ['US', 'FR', 'GB', 'XX'][c_custkey % 4 + 1] AS cc, '1' || right('0000' || c_custkey::VARCHAR, 4) AS num, c_custkey % 3 = 0 AS x FROM customer),
 s AS (SELECT *, CASE WHEN x THEN CASE WHEN cc = 'FR' THEN num || 'CE' ELSE num || ' CEDEX' END ELSE num END AS short FROM c),
 v AS (SELECT *, CASE WHEN cc <> 'XX' AND length(short) <= 9 THEN list_reduce(list_prepend(0::BIGINT, list_transform(string_split(short, ''), lambda y: (strpos('{ZIP_ALPHABET}', y) - 1)::BIGINT)), lambda a, y: a * 38 + y) + ((list_position({_LIST(ZIP_COUNTRIES)}, cc) - 1)::BIGINT << 48) END AS packed FROM s)
 SELECT c_custkey, packed, CASE WHEN packed IS NOT NULL THEN cc END AS cc, CASE WHEN packed IS NOT NULL THEN CASE WHEN cc = 'FR' AND x THEN num || ' CEDEX' ELSE num END END AS code FROM v""",
    "best_name": GAZ + """, s AS (SELECT *, CASE WHEN lang = 'en' THEN 40.0 ELSE -20.0 END + CASE WHEN flags & 1 <> 0 THEN 5.0 ELSE 0.0 END - length(name) * 0.0001 AS en, CASE WHEN lang = 'en' THEN 20.0 ELSE -20.0 END + CASE WHEN flags & 1 <> 0 THEN 5.0 ELSE 0.0 END - length(name) * 0.0001 AS fr, CASE WHEN flags & 2 <> 0 THEN 1000.0 ELSE 0.0 END AS ab FROM nm)
 SELECT fid, max_by(name, en) AS en, max_by(name, fr) AS fr, max_by(name, en + ab) AS short FROM s GROUP BY fid""",
    "phrase_match": GAZ + f""", {_REQ}, t AS (SELECT qid, string_split(concat('pizza ', town, ' ', division), ' ') AS w FROM req), a AS (SELECT qid, w, unnest(generate_series(0, len(w) - 1)) AS start FROM t), b AS (SELECT qid, w, start, unnest(generate_series(start + 1, len(w))) AS "end" FROM a), {_ROWS}
 SELECT qid, start::INT AS start, "end"::INT AS "end", fid FROM b JOIN rowsx ON name = array_to_string(w[start + 1:"end"], ' ')""",
    "geocode_requests": GAZ + f""", {_REQ}, n2 AS (SELECT fid, name, cc, woe, population, parents, {_normal('name')} AS nn FROM f),
 d AS (SELECT qid, town, division, want, n2.* FROM req JOIN n2 ON nn = division), t AS (SELECT d.qid, d.want, d.division, x.fid, x.name, x.cc, x.population, x.parents, d.fid AS did, d.name AS dname, d.town FROM d JOIN n2 x ON x.nn = d.town AND x.cc = d.cc AND list_contains(x.parents, d.fid)),
 k AS (SELECT qid, want, fid, 1 AS size, population - 5000 - 7 AS base, cc, 'pizza ' || town AS what, division AS place, name, [NULL, cc] AS tail, fid::VARCHAR AS fids, 3 AS start FROM d
  UNION ALL SELECT qid, want, fid, 2, population - 10000 - 4 - 7, cc, 'pizza', town || ' ' || division, name, [dname, cc], fid::VARCHAR || ',' || did::VARCHAR, 1 FROM t),
 s AS (SELECT *, base + CASE WHEN want = cc THEN 1000000 ELSE 0 END AS score FROM k), u AS (SELECT *, row_number() OVER (PARTITION BY qid, fid ORDER BY start) AS own FROM s),
 v AS (SELECT *, count(*) OVER (PARTITION BY qid ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS longer FROM u WHERE own = 1), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, fid) AS rank FROM v WHERE longer < 6)
 SELECT qid, rank::INT AS rank, fid, score::BIGINT AS score, what, place, array_to_string(list_filter([name, tail[1], CASE WHEN want IS NULL OR want <> cc THEN cc END], lambda x: x IS NOT NULL), ', ') AS display_name, fids FROM r WHERE rank <= 3""",
    "score_profiles": GAZ + f""", {_VARIED}, p AS (SELECT *, {_meters('lat', 'lng', '10.0', '20.0')} AS m FROM v), q AS (SELECT *, {_BASE} AS base, CASE WHEN cc = 'AF' THEN CASE WHEN woe = 11 THEN 11000000 ELSE 1000000 END ELSE 0 END AS hint, CASE WHEN cc <> 'AF' THEN -100000000 ELSE 0 END AS miss, {_DIST.replace('FAR', '-100000')} AS dc, {_DIST.replace('FAR', '-m')} AS du, CASE WHEN woe = 14 THEN -50000000 ELSE 0 END AS air, CASE WHEN world THEN 0 ELSE -100000000 END AS small_city FROM p)
 SELECT fid, (base + population + hint + dc + boost)::BIGINT AS geocode, (base + trunc(population * 0.1::DOUBLE) + hint * 10 + dc + trunc(boost * 0.001::DOUBLE) + air)::BIGINT AS "default", (base + trunc(population * 0.1::DOUBLE) + small_city + hint * 10 + trunc(boost * 0.001::DOUBLE) + air)::BIGINT AS world_city, (base + trunc(population * 0.001::DOUBLE) + hint * 10 + du + trunc(boost * 0.00001::DOUBLE) + air)::BIGINT AS local, (base + population + trunc(hint * 0.001::DOUBLE) + trunc(dc * 0.0001::DOUBLE) + boost + air)::BIGINT AS "global", (base + dc + air)::BIGINT AS strict_local, (base + population + miss + boost + air)::BIGINT AS in_country FROM q""",
    "bounds_distance": GAZ + f""", {_VARIED}, o AS (SELECT *, lat + CASE key % 4 WHEN 1 THEN 0.75::DOUBLE WHEN 2 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END AS y, CASE WHEN key % 4 = 3 THEN 20.0::DOUBLE ELSE 0.7::DOUBLE END AS h FROM v),
 w AS (SELECT *, y - h AS s, y + h AS n, lng - h AS west, lng + h AS e FROM o), z AS (SELECT *, (s + n) / 2 AS cy, CASE WHEN (west + e) / 2 > 180 THEN (west + e) / 2 - 360 ELSE (west + e) / 2 END AS cx FROM w),
 p AS (SELECT *, {_meters('lat', 'lng', 'cy', 'cx')} AS m, {_meters('s', 'west', 'n', 'e')} < 200000 AND (lat BETWEEN s AND n OR (has_box AND s <= lat + 0.1::DOUBLE AND lat - 0.1::DOUBLE <= n)) AS near FROM z),
 q AS (SELECT *, {_BASE_ALONE} AS base, CASE WHEN near THEN CASE WHEN woe = 22 THEN 5000000 ELSE 2000000 END ELSE {_DIST.replace('FAR', '-100000')} END AS dc, CASE WHEN near THEN CASE WHEN woe = 22 THEN 5000000 ELSE 2000000 END ELSE {_DIST.replace('FAR', '-m')} END AS du, CASE WHEN woe = 14 THEN -50000000 ELSE 0 END AS air FROM p)
 SELECT fid, (base + population + dc + boost)::BIGINT AS score, (base + trunc(population * 0.001::DOUBLE) + du + trunc(boost * 0.00001::DOUBLE) + air)::BIGINT AS local FROM q""",
    "dedupe_interpretations": """WITH RECURSIVE p AS (SELECT substr(p_brand, 7, 5)::BIGINT AS qid, p_brand, (6::BIGINT << 56) + p_partkey AS fid, lower(p_name) AS label, floor(p_retailprice)::BIGINT AS population, p_partkey % 3 = 2 AS hinted, p_partkey % 4 = 0 AS alias, p_partkey % 5 = 0 AS poly, CASE p_partkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 6 ELSE 3 END AS ord, ((p_partkey % 40)::DOUBLE * 0.1::DOUBLE - 2) / 0.15::DOUBLE AS fy, ((p_partkey % 7)::DOUBLE * 0.13::DOUBLE - 0.4::DOUBLE) / 0.15::DOUBLE AS fx FROM part),
 ranked AS (SELECT *, trunc(fy)::BIGINT AS y, trunc(fx)::BIGINT AS x, row_number() OVER (PARTITION BY qid ORDER BY population DESC, fid) AS rank FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rank) AS n FROM ranked),
 laid AS (SELECT qid, label, n, rank, [y, x] AS b, [[y, x]] AS taken FROM o WHERE n = 1
  UNION ALL SELECT qid, label, n, rank, c[1], list_append(taken, c[1]) FROM (SELECT o.qid, o.label, o.n, o.rank, l.taken, list_append(list_filter([[y, x], [y, x - 1], [y, x + 1], [y - 1, x], [y - 1, x - 1], [y - 1, x + 1], [y + 1, x], [y + 1, x - 1], [y + 1, x + 1]], lambda z: list_contains(l.taken, z)), [y, x]) AS c FROM laid l JOIN o ON o.qid = l.qid AND o.label = l.label AND o.n = l.n + 1)),
 best AS (SELECT ranked.*, row_number() OVER w AS k, count(*) OVER (PARTITION BY ranked.qid, ranked.label, laid.b) AS merged FROM ranked JOIN laid USING (qid, label, rank) WINDOW w AS (PARTITION BY ranked.qid, ranked.label, laid.b ORDER BY hinted DESC, alias, poly DESC, ord, rank))
 SELECT qid, (row_number() OVER (PARTITION BY qid ORDER BY rank))::INT AS rank, fid, merged::INT AS n FROM best WHERE k = 1""",
    "request_filters": GAZ + f""", {_REQ}, n2 AS (SELECT fid, name, cc, woe, population, parents, lat, lng, {_normal('name')} AS nn FROM f), d AS (SELECT qid, town, division, want, n2.* FROM req JOIN n2 ON nn = division), t AS (SELECT d.qid, d.want, x.fid, x.cc, x.population, x.lat, x.lng FROM d JOIN n2 x ON x.nn = d.town AND x.cc = d.cc AND list_contains(x.parents, d.fid)),
 k AS (SELECT qid, want, fid, population - 5000 - 7 AS base, cc, 8 AS woe, lat, lng, 3 AS start FROM d UNION ALL SELECT qid, want, fid, population - 10000 - 4 - 7, cc, 7, lat, lng, 1 FROM t),
 m AS (SELECT *, {_meters('lat', 'lng', '-40.0', '0.0')} AS m FROM k WHERE CASE qid % 4 WHEN 1 THEN woe = 7 WHEN 2 THEN fid >> 56 = 1 WHEN 3 THEN lat BETWEEN -80 AND 0 AND (want IS NULL OR cc = want) ELSE true END),
 s AS (SELECT *, base + CASE WHEN want = cc THEN 1000000 ELSE 0 END + CASE WHEN qid % 4 = 3 THEN {_DIST.replace('FAR', '-100000')} ELSE 0 END AS score FROM m), u AS (SELECT *, row_number() OVER (PARTITION BY qid, fid ORDER BY start) AS own FROM s),
 v AS (SELECT *, count(*) OVER (PARTITION BY qid ORDER BY start RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS longer FROM u WHERE own = 1), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, fid) AS rank FROM v WHERE longer < 6) SELECT qid, rank::INT AS rank, fid, score::BIGINT AS score FROM r WHERE rank <= 3""",
    "request_parse": """SELECT c_custkey AS qid, c_name || ' x' AS query, 1.5::DOUBLE AS lat, c_nationkey::DOUBLE AS lng, '7,22' AS hints, 30::DOUBLE AS radius, nullif(c_nationkey, 0)::INT AS max_interpretations, 'osm,tgn' AS sources, 'ALL_NAMES,PARENTS' AS includes, CASE WHEN c_nationkey % 2 = 0 THEN 'local' ELSE 'balanced' END AS bias, CASE WHEN c_nationkey % 2 = 0 THEN 'autocomplete' ELSE 'slug' END AS mode, CASE WHEN c_custkey % 2 = 0 THEN 1::DOUBLE END AS west FROM customer""",
    "primary_promotion": """SELECT (3::BIGINT << 56) + c_custkey AS fid, c_name AS name, 'en' AS lang, CASE WHEN c_custkey % 5 = 3 THEN 0 ELSE 1 END AS flags FROM customer
 UNION ALL SELECT (3::BIGINT << 56) + c_custkey, c_name, 'en', 0 FROM customer WHERE c_custkey % 5 = 2 UNION ALL SELECT (3::BIGINT << 56) + c_custkey, c_mktsegment, CASE WHEN c_custkey % 5 = 3 THEN 'en' ELSE 'fr' END, CASE WHEN c_custkey % 5 = 3 THEN 1 ELSE 0 END FROM customer WHERE c_custkey % 5 > 2""",
    "reverse_geocode_boxes": GAZ + """, b AS (SELECT *, CASE WHEN woe = 7 THEN 0.33 ELSE 21.07 END AS h FROM f WHERE woe IN (7, 8)), i AS (SELECT p.fid AS qid, b.fid, b.woe, CASE b.fid >> 56 WHEN 3 THEN 2 WHEN 1 THEN 3 WHEN 5 THEN 0 END AS quality FROM f p JOIN b ON p.woe IN (20, 22) AND abs(p.lat - b.lat) < h AND least(abs(p.lng - b.lng), 360 - abs(p.lng - b.lng)) < h),
 r AS (SELECT qid, fid, row_number() OVER (PARTITION BY qid ORDER BY CASE woe WHEN 7 THEN 4 ELSE 7 END, quality DESC, fid) AS rank FROM i) SELECT qid, rank::INT AS rank, fid FROM r WHERE rank <= 5""",
    "slug_assign": GAZ + """, b AS (SELECT *, replace(regexp_replace(lower(name), '[^a-z0-9 /-]', '', 'g'), ' ', '-') AS base FROM f), o AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY population DESC, fid) AS n FROM b),
 t AS (SELECT *, row_number() OVER (PARTITION BY n > 1, base, cc ORDER BY population DESC, fid) AS m FROM o) SELECT fid, CASE WHEN n = 1 THEN base WHEN m = 1 THEN base || '-' || lower(cc) ELSE base || '-' || lower(cc) || '-' || woe || '-' || (fid & 72057594037927935) END AS slug FROM t""",
    "highlight_names": "SELECT c_custkey, '<b>' || left(c_name, 11) || '</b>' || substr(c_name, 12) AS marked FROM customer",
    "autocomplete_requests": GAZ + f""", ask AS (SELECT c_custkey AS qid, {_normal('left(c_name, length(c_name) - 1)')} AS prefix FROM customer), n2 AS (SELECT fid, name, cc, population, {_normal('name')} AS nn FROM f WHERE woe NOT IN (8, 12, 29)),
 t0 AS (SELECT qid, fid, name, CASE WHEN cc = 'AF' THEN 1000000 ELSE 0 END AS hint, CASE WHEN cc = 'AF' THEN 0 ELSE -100000000 END AS miss, population, -5000 - 4 AS base, NULL::INT AS grp, NULL::BIGINT AS score FROM ask JOIN n2 ON starts_with(nn, prefix)){_rankers()}
 , last AS (SELECT qid, fid, name, coalesce(grp, {len(_RANKERS)}) AS grp, coalesce(score, base + trunc(population * 0.1::DOUBLE)::BIGINT + hint * 10) AS score FROM t{len(_RANKERS)}), r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY grp, score DESC, fid) AS rank FROM last) SELECT qid, rank::INT AS rank, fid, score::BIGINT AS score, name FROM r WHERE rank <= 3""",
    "s2_cells": GAZ + f""", a AS (SELECT fid, radians(lat + 0.0137::DOUBLE) AS phi, radians(lng + 0.0171::DOUBLE) AS theta FROM f), b AS (SELECT fid, cos(phi) * cos(theta) AS x, cos(phi) * sin(theta) AS y, sin(phi) AS z FROM a),
 c AS (SELECT *, CASE WHEN abs(x) >= abs(y) AND abs(x) >= abs(z) THEN CASE WHEN x < 0 THEN 3 ELSE 0 END WHEN abs(y) >= abs(z) THEN CASE WHEN y < 0 THEN 4 ELSE 1 END ELSE CASE WHEN z < 0 THEN 5 ELSE 2 END END AS face FROM b),
 e AS (SELECT fid, face, CASE face WHEN 0 THEN y / x WHEN 1 THEN -x / y WHEN 2 THEN -x / z WHEN 3 THEN z / x WHEN 4 THEN z / y ELSE -y / z END AS u, CASE face WHEN 0 THEN z / x WHEN 1 THEN z / y WHEN 2 THEN -y / z WHEN 3 THEN y / x WHEN 4 THEN -x / y ELSE -x / z END AS v FROM c),
 h0 AS (SELECT fid, face, {_st('u')} AS i, {_st('v')} AS j, 0::BIGINT AS pos, face & 1 AS turn FROM e){_curve(12)},
 k AS (SELECT fid, face::HUGEINT * 2305843009213693952 + pos::HUGEINT * 137438953472 + 68719476736 AS id FROM h12), s AS (SELECT fid, (CASE WHEN id >= 9223372036854775808 THEN id - 18446744073709551616 ELSE id END)::BIGINT AS cell FROM k) SELECT fid, cell, (cell & -17592186044416) | 17592186044416 AS parent FROM s""",
    "dedupe_by_primary": """WITH a AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY l_quantity DESC, l_linenumber, l_suppkey) AS n FROM lineitem), b AS (SELECT l_orderkey, l_partkey, l_quantity::BIGINT AS score, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_partkey)::INT AS rank FROM a WHERE n = 1) SELECT l_orderkey, rank, l_partkey, score FROM b WHERE rank <= 3""",
    "ambiguous_names": GAZ + " SELECT fid, n FROM (SELECT fid, count(*) OVER (PARTITION BY cc, lower(name)) AS n FROM f) WHERE n > 1",
    "distance_buckets": GAZ + f""", r AS (SELECT a.fid AS a, least(20, {_meters('a.lat', 'a.lng', 'b.lat', 'b.lng')} // 1000000)::BIGINT AS bucket, {_miles('a.lat', 'a.lng', 'b.lat', 'b.lng')} AS miles FROM f a JOIN f b ON a.woe = 8 AND b.woe = 7 AND a.parents[1] = b.parents[2]) SELECT a, bucket, count(*) AS n, floor(max(miles))::BIGINT AS miles FROM r GROUP BY 1, 2""",
    "bounds_hint": GAZ + " SELECT fid, lat BETWEEN -10 AND 30 AND lng BETWEEN -20 AND 40 AS plain, lat BETWEEN -50 AND 50 AND (lng >= 170 OR lng <= -170) AS wrapped FROM f",
    "quantized_bucket": GAZ + " SELECT cc, trunc(lat / 0.15::DOUBLE)::BIGINT AS by, trunc(lng / 0.15::DOUBLE)::BIGINT AS bx, count(*) AS n, max_by(fid, {'p': population, 'f': fid}) AS best FROM f GROUP BY 1, 2, 3",
    "grid_reverse_geocode": GAZ + " SELECT p.fid AS qid, b.fid FROM f p JOIN f b ON p.woe = 7 AND b.woe = 8 AND p.lat BETWEEN b.lat - 12 AND b.lat + 12 AND p.lng BETWEEN b.lng - 25 AND b.lng + 25",
    "bulk_reply_index": """WITH l AS (SELECT l_orderkey % 100 AS batch, l_orderkey AS qid, l_linenumber AS rank, min(l_partkey) AS fid FROM lineitem GROUP BY l_orderkey, l_linenumber), p AS (SELECT *, dense_rank() OVER (PARTITION BY batch ORDER BY fid) - 1 AS pos FROM l) SELECT batch, qid, string_agg(pos::VARCHAR, ',' ORDER BY rank, pos) AS positions FROM p GROUP BY 1, 2""",
    "edit_apply": GAZ + """, e AS (SELECT (3::BIGINT << 56) + o_custkey AS fid, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' AND o_orderkey % 7 = 0 THEN 'Remove' WHEN o_orderstatus = 'P' THEN 'Add' ELSE 'Modify' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN floor(o_totalprice)::BIGINT END AS population, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 90)::DOUBLE END AS lat FROM orders),
 g AS (SELECT fid, bool_or(kind = 'Remove') AS gone, arg_max(population, seq) FILTER (kind = 'Modify' AND population IS NOT NULL) AS np, arg_max(lat, seq) FILTER (kind = 'Modify' AND lat IS NOT NULL) AS nl FROM e GROUP BY fid)
 SELECT f.fid, coalesce(np, f.population) AS population, coalesce(nl, f.lat) AS lat, f.lng FROM f LEFT JOIN g USING (fid) WHERE woe = 7 AND NOT coalesce(gone, false)""",
    "hotfix_overlay": GAZ + """, e AS (SELECT user_id, (3::BIGINT << 56) + user_id AS fid, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS population, bool_or(event_type = 'error') AS gone FROM events GROUP BY 1, 2),
 a AS (SELECT fid, cc, population FROM f WHERE fid NOT IN (SELECT fid FROM e) UNION ALL SELECT fid, 'XX', population FROM e) SELECT * FROM a WHERE fid NOT IN (SELECT fid FROM e WHERE gone AND user_id % 3 = 0)""",
    "id_mapping_build": GAZ + " SELECT key, min(fid) AS fid FROM (SELECT regexp_replace(lower(name), '[ #]', '-', 'g') AS key, fid FROM f UNION ALL SELECT (fid & 72057594037927935)::VARCHAR, fid FROM f WHERE fid & 72057594037927935 <> fid) GROUP BY key",
    "slug_lookup": GAZ + """, m AS (SELECT key, min(fid) AS fid FROM (SELECT regexp_replace(lower(name), '[ #]', '-', 'g') AS key, fid FROM f UNION ALL SELECT (fid & 72057594037927935)::VARCHAR, fid FROM f WHERE fid & 72057594037927935 <> fid) GROUP BY key),
 c AS (SELECT c_custkey AS qid, CASE WHEN c_custkey % 3 = 0 THEN regexp_replace(lower(c_name), '[ #]', '-', 'g') WHEN c_custkey % 3 = 1 THEN 'adhoc:' || c_custkey::VARCHAR ELSE 'no-such-place' END AS key FROM customer)
 SELECT qid, c.key, CASE WHEN m.fid IS NOT NULL THEN m.fid WHEN starts_with(c.key, 'adhoc:') THEN (3::BIGINT << 56) + qid END AS fid FROM c LEFT JOIN m ON c.key = m.key""",
    "semi_join_notable": "SELECT p_partkey, p_name FROM part WHERE p_type = 'PROMO' AND EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R' AND l_quantity > 45)",
    "eval_diff_counts": """WITH l AS (SELECT l_orderkey, l_partkey, max(l_quantity) AS q, max(l_discount) AS x FROM lineitem GROUP BY 1, 2), a AS (SELECT l_orderkey, arg_max(l_partkey, {'q': q, 'p': l_partkey}) AS old FROM l WHERE q IS NOT NULL GROUP BY 1), b AS (SELECT l_orderkey, arg_max(l_partkey, {'x': x, 'p': l_partkey}) AS new FROM l WHERE x IS NOT NULL GROUP BY 1),
 c AS (SELECT old, new, CASE WHEN old IS NULL THEN 'geocoded more' WHEN new IS NULL THEN 'geocoded less' WHEN old = new THEN 'same' ELSE 'changed' END AS outcome FROM a FULL JOIN b USING (l_orderkey)) SELECT outcome, count(*) AS n, count(DISTINCT CASE WHEN old IS NOT NULL AND new IS NOT NULL THEN old::VARCHAR || '-' || new::VARCHAR END) AS pairs FROM c GROUP BY 1""",
    "missing_parents": GAZ + " SELECT DISTINCT x AS fid FROM (SELECT unnest(parents) AS x FROM f WHERE woe = 7) WHERE x NOT IN (SELECT (1::BIGINT << 56) + s_nationkey FROM supplier WHERE s_acctbal > 5000)",
    "order_keys": "SELECT l_suppkey, (row_number() OVER (PARTITION BY l_suppkey ORDER BY cell < 0, cell))::INT AS n, cell FROM (SELECT DISTINCT l_suppkey, (l_orderkey - 5000) * 7 + l_linenumber AS cell FROM lineitem)",
    "list_edits": GAZ + """, t AS (SELECT fid, parents, fid & 72057594037927935 AS k FROM f WHERE woe = 7), v AS (SELECT *, parents[k % 2 + 1] AS v FROM t), e AS (SELECT *, CASE k % 3 WHEN 0 THEN list_append(list_filter(parents, lambda x: x <> v), v) WHEN 1 THEN list_filter(parents, lambda x: x <> v) ELSE parents END AS l FROM v)
 SELECT fid, array_to_string(l, ',') AS parents, len(l) = 0 AS emptied FROM e""",
    "concordances": GAZ + " SELECT f.fid, f.fid::VARCHAR || coalesce(',' || string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey), '') AS ids FROM f LEFT JOIN supplier ON (1::BIGINT << 56) + s_nationkey = f.fid WHERE woe = 8 GROUP BY f.fid",
    "slug_join": GAZ + """, o AS (SELECT (3::BIGINT << 56) + o_custkey AS fid, 's' || o_orderkey AS slug, floor(o_totalprice)::BIGINT AS score, o_orderstatus = 'F' AS gone FROM orders), g AS (SELECT fid, string_agg(slug, ',' ORDER BY gone, score DESC, slug) AS slugs FROM o GROUP BY fid)
 SELECT f.fid, string_split(slugs, ',')[1] AS slug, slugs FROM f LEFT JOIN g USING (fid) WHERE woe = 7""",
    "attribute_join": GAZ + """, a AS (SELECT (6::BIGINT << 56) + l_partkey AS fid, l_linenumber AS s, CASE WHEN l_returnflag = 'R' THEN 1 END AS w FROM lineitem), m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY fid ORDER BY s, w NULLS FIRST) AS n FROM a) WHERE n = 1)
 SELECT f.fid, coalesce(m.s, 20)::INT AS scalerank, m.w::INT AS worldcity FROM f LEFT JOIN m USING (fid) WHERE woe IN (20, 22)""",
    "extract_divisions": """WITH n AS (SELECT n_nationkey AS k, n_name FROM nation), c AS (SELECT *, k % 4 + 1 AS level, CASE WHEN k % 2 = 1 THEN 2 ELSE 1 END AS depth FROM n WHERE k % 4 <> 3)
 SELECT 'US.S' || (k % 5)::VARCHAR || CASE WHEN depth = 2 THEN '.' || k::VARCHAR ELSE '' END AS path, n_name AS name, lower(n_name) AS ascii, k::VARCHAR AS id FROM c WHERE level = depth""",
    "round_robin_countries": GAZ + " SELECT fid, cc, population FROM (SELECT fid, cc, population, row_number() OVER (PARTITION BY cc ORDER BY population DESC, fid) AS n FROM f WHERE woe = 7) ORDER BY n, cc LIMIT 50",
}
