"""The engine's queries against their SQL on the smallest tables."""

import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from chartloom import queries
from chartloom.functions import prompts

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables here")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows) if all(x is not None for r in rows for x in r) else sorted((tuple(map(str, r)) for r in rows))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, db, name):
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    result = db.sql(queries.ORACLE_SQL[name])
    assert sorted(result.columns) == columns
    want = db.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in columns)} FROM ({queries.ORACLE_SQL[name]})").fetchall()
    assert plain([tuple(r) for r in df.select(columns).collect()]) == plain(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_other_queries_run(spark, db, name):
    assert queries.QUERIES[name](spark, FOLDER).count() > 0


def test_scores_are_printed_as_sql_prints_them(spark, tmp_path):
    # 0.42965 as a double is a little less, 0.03125 is a tie, -1e-7 rounds to a zero that keeps its sign
    cosines = [0.42965, 0.00005, 0.03125, 0.41235, 0.0, -1e-7, -0.12345]
    vectors = {20 * i: [[1.0, 0.0]] for i in range(len(cosines) + 1)}
    rows = [(i, v[0], i) for i, v in vectors.items()] + [(20 * i + 1, [c, math.sqrt(1 - c * c)], 20 * i) for i, c in enumerate(cosines)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label long").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = {tuple(r) for r in queries.prompt_blocks(spark, str(tmp_path)).select("query_id", "block").collect()}
    assert got == set(con.sql(f"SELECT query_id, block FROM ({queries.ORACLE_SQL['prompt_blocks']})").fetchall())
    numbers = [x / 1e5 for x in range(-1000, 1000)] + [x / 1024 for x in range(64)] + [12345678.00005, 3e20, -0.0, float("nan"), float("-inf")]
    printed = spark.createDataFrame([(x,) for x in numbers], "x double").select("x", prompts.fixed(F.col("x"), 4), prompts.fixed(F.col("x"), 2)).collect()
    assert [(a, b) for _, a, b in printed] == [(f"{x:.4f}", f"{x:.2f}") for x, _, _ in printed]
