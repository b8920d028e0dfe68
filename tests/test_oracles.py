"""The catalogue against its DuckDB SQL, and the driver contract."""

import math

import pytest

import __spark_entry__ as entry
from atlasweave.plans.catalog import QUERIES
from atlasweave.plans.oracles import ORACLES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, duck, name):
    cur = duck.execute(ORACLES[name])
    cols, kinds = [c[0] for c in cur.description], {c[0]: TYPES.get(str(c[1]), str(c[1])) for c in cur.description}
    want = cur.fetchall()
    df = QUERIES[name](spark, DIR)
    assert kinds == dict(df.dtypes)
    key = sorted(cols)
    rows = lambda data, names: sorted((tuple(plain(r[names.index(c)]) for c in key) for r in data), key=repr)
    assert want and rows(want, cols) == rows([tuple(r) for r in df.collect()], df.columns)


def test_order_keys_are_whole(spark, duck):
    cells = duck.execute("SELECT DISTINCT l_suppkey, (l_orderkey - 5000) * 7 + l_linenumber AS cell FROM lineitem").fetchall()
    held = {}
    for supplier, cell in cells:
        held.setdefault(supplier, []).append(cell)
    want = {(k, n, c) for k, v in held.items() for n, c in enumerate(sorted(v, key=lambda c: c % 2**64), 1)}
    got = [tuple(r) for r in QUERIES["order_keys"](spark, DIR).collect()]
    assert len(got) == len(want) == len(cells) and set(got) == want
    assert sorted(got) == sorted(duck.execute(ORACLES["order_keys"]).fetchall())


def test_slug_join_takes_every_order(spark, duck):
    held = {}
    for customer, order, price, status in duck.execute("SELECT o_custkey, o_orderkey, o_totalprice, o_orderstatus FROM orders").fetchall():
        held.setdefault((3 << 56) + customer, []).append((status == "F", -math.floor(price), f"s{order}"))
    got = QUERIES["slug_join"](spark, DIR).collect()
    want = {r["fid"]: [s for _, _, s in sorted(held.get(r["fid"], []))] for r in got}
    assert {r["fid"]: (r["slug"], r["slugs"]) for r in got} == {k: (v[0], ",".join(v)) if v else (None, None) for k, v in want.items()}
    towns = duck.execute("SELECT count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)").fetchone()[0]
    assert sum(map(len, want.values())) == towns


def test_autocomplete_requests_take_every_customer(spark, duck):
    every = {r[0] for r in duck.execute("SELECT c_custkey FROM customer").fetchall()}
    got = [(r["qid"], r["rank"]) for r in QUERIES["autocomplete_requests"](spark, DIR).collect()]
    assert {q for q, _ in got} == every and len(got) == len(set(got))


def test_eval_diff_counts_compares_every_order(spark, tmp_path):
    rows = [(10, 1, 5, 0.1), (10, 2, 6, 0.2), (11, 3, 5, 0.1), (11, 4, 6, 0.0), (12, 5, None, 0.1), (13, 6, 7, None), (22, 7, 1, 0.1), (20, 8, 2, None), (20, 9, None, 0.3)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {tuple(r) for r in QUERIES["eval_diff_counts"](spark, str(tmp_path)).collect()}
    assert got == {("same", 2, 2), ("changed", 2, 2), ("geocoded more", 1, 0), ("geocoded less", 1, 0)}


def test_attribute_join_reads_every_line(spark, duck, tmp_path):
    for t in set(TABLES) - {"lineitem"}:
        (tmp_path / f"{t}.parquet").symlink_to(f"{DIR}/{t}.parquet")
    duck.execute(f"COPY (SELECT * FROM lineitem WHERE l_linenumber > 2) TO '{tmp_path}/lineitem.parquet' (FORMAT parquet)")
    least = dict(duck.execute("SELECT (6::BIGINT << 56) + l_partkey, min(l_linenumber) FROM lineitem WHERE l_linenumber > 2 GROUP BY 1").fetchall())
    got = QUERIES["attribute_join"](spark, str(tmp_path)).collect()
    assert any(r["fid"] in least for r in got) and all(r["scalerank"] == least.get(r["fid"], 20) for r in got)


def test_postal_codes_of_long_keys(spark, duck, tmp_path):
    duck.execute(f"COPY (SELECT c_custkey * 997 AS c_custkey FROM customer) TO '{tmp_path}/customer.parquet' (FORMAT parquet)")
    got = {tuple(r) for r in QUERIES["postal_id_codec"](spark, str(tmp_path)).collect()}
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{tmp_path}/customer.parquet'")
    assert max(r[0] for r in got) > 100_000 and got == set(con.execute(ORACLES["postal_id_codec"]).fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_queries_without_sql_give_rows(spark, name):
    assert QUERIES[name](spark, DIR).count() > 0


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
