"""Types and fixed values of the gazetteer."""

from __future__ import annotations

# Place types.
UNKNOWN, TOWN, ADMIN1, ADMIN2, ADMIN3, POSTAL_CODE, COUNTRY = 0, 7, 8, 9, 10, 11, 12
ISLAND, AIRPORT, PARK, POI, SUBURB, CONTINENT = 13, 14, 16, 20, 22, 29

# The names of place types and of the parts of a reply, with their numbers.
WOE_NAMES = {"UNKNOWN": 0, "TOWN": 7, "ADMIN1": 8, "ADMIN2": 9, "ADMIN3": 10, "POSTAL_CODE": 11, "COUNTRY": 12, "ISLAND": 13, "AIRPORT": 14, "DRAINAGE": 15, "PARK": 16, "POI": 20, "SUBURB": 22, "SPORT": 23, "COLLOQUIAL": 24, "ZONE": 25, "HISTORICAL_STATE": 26, "HISTORICAL_COUNTY": 27, "CONTINENT": 29, "TIMEZONE": 31, "HISTORICAL_TOWN": 35, "STREET": 100}
INCLUDES = {"EVERYTHING": 0, "PARENTS": 1, "ALL_NAMES": 2, "PARENT_ALL_NAMES": 3, "WKB_GEOMETRY": 4, "WKT_GEOMETRY": 5, "REVGEO_COVERAGE": 6, "DISPLAY_NAME": 7, "WKB_GEOMETRY_SIMPLIFIED": 8, "WKT_GEOMETRY_SIMPLIFIED": 9, "S2_COVERING": 10, "S2_INTERIOR": 11}

#: From specific to general; a type that isn't listed sorts before all as an ordering (-1) and after all when compared.
SPECIFIC_TO_GENERAL = [POSTAL_CODE, AIRPORT, POI, SUBURB, TOWN, ADMIN3, ADMIN2, ADMIN1, COUNTRY]

# Flags of names, powers of two.
PREFERRED, ABBREVIATION, DEACCENT, ALIAS, LOCAL_LANG, ALT_NAME = 1, 2, 4, 8, 16, 32
COLLOQUIAL, SHORT_NAME, NEVER_DISPLAY, LOW_QUALITY, HISTORIC = 64, 128, 256, 512, 1024

# Namespaces of feature ids.
NAMESPACES = {"maponics": 0, "geonameid": 1, "geonamezip": 2, "adhoc": 3, "woeid": 4, "osm": 5, "tgn": 6}
#: From worst to best when ranking; a namespace that isn't listed has -1.
NAMESPACE_QUALITY = ["osm", "woeid", "adhoc", "geonameid", "maponics", "tgn"]

# What postal ids are made of.
ZIP_COUNTRIES = "AD AR AS AT AU BD BE BG BR CA CH CZ DE DK DO ES FI FO FR GB GF GG GL GP GT GU GY HR HU IM IN IS IT JE JP LI LK LT LU MC MD MH MK MP MQ MX MY NL NO NZ PH PK PL PM PR PT RE RU SE SI SJ SK SM TH TR US VA VI YT ZA".split()
ZIP_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ- "

# Words dropped from a query when it isn't understood whole.
CONNECTORS = ["near"]

# Levels of cells.
REVGEO_LEVELS, REVGEO_MAX_CELLS = (8, 10, 12), 1000
COVER_LEVELS, COVER_MAX_CELLS = (4, 20), 50
INTERIOR_LEVELS, INTERIOR_MAX_CELLS = (4, 18), 100

FEATURES = "fid bigint, cc string, woe int, lat double, lng double, population bigint, boost bigint, parents array<bigint>, extras array<bigint>, has_poly boolean, can_geocode boolean"
NAMES = "fid bigint, name string, lang string, flags int"
REQUESTS = "qid bigint, query string, cc string, lang string, lat double, lng double, woe_hint array<int>, max_interpretations int"

_BOX = "struct<south:double,west:double,north:double,east:double>"
#: Columns that features may have besides FEATURES: bounds, whether it is a world city, its ids at other sources as ``source:id``.
FEATURE_OPTIONS = {"box": _BOX, "world_city": "boolean", "other_ids": "array<string>"}
#: Columns that requests may have besides REQUESTS. Bounds go before lat and lng; strict keeps places inside of the request's
#: bounds or circle and in its country alone; autocomplete and slug choose how a request is answered.
REQUEST_OPTIONS = {"bounds": _BOX, "radius": "double", "strict": "boolean", "woe_restrict": "array<int>", "allowed_sources": "array<string>", "autocomplete": "boolean", "bias": "string", "slug": "string", "includes": "array<string>"}

# Multipliers of scoring terms by profile; a term that isn't named has 0.
PROFILES = {
    "geocode": {"population": 1.0, "country_hint": 1.0, "distance_clamped": 1.0, "boost": 1.0},
    "default": {"population": 0.1, "country_hint": 10.0, "distance_clamped": 1.0, "boost": 0.001, "airport": 1.0},
    "world_city": {"population": 0.1, "world_city": 1.0, "country_hint": 10.0, "distance_clamped": 0.0, "boost": 0.001, "airport": 1.0},
    "local": {"population": 0.001, "country_hint": 10.0, "distance_unclamped": 1.0, "boost": 0.00001, "airport": 1.0},
    "global": {"population": 1.0, "country_hint": 0.001, "distance_clamped": 0.0001, "boost": 1.0, "airport": 1.0},
    "strict_local": {"population": 0.0, "country_hint": 0.0, "distance_clamped": 1.0, "boost": 0.0, "airport": 1.0},
    "in_country": {"population": 1.0, "country_mismatch": 1.0, "distance_clamped": 0.0, "boost": 1.0, "airport": 1.0},
}
