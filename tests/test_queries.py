"""Every registered query that SQL can express equals its SQL on DuckDB."""

from __future__ import annotations

import dataclasses

import duckdb
import pytest
from conftest import rows

from montage.operators import locate
from montage.params import DEFAULTS
from montage.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def test_sql_belongs_to_queries():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, data, duck):
    found = catalog.QUERIES[name](spark, data)
    got = found.collect()
    assert got
    if name in catalog.ORACLE_SQL:
        result = duck.execute(catalog.ORACLE_SQL[name])
        columns = sorted(c[0] for c in result.description)
        names = [c[0] for c in result.description]
        assert columns == sorted(found.columns)
        assert rows(got, columns) == rows([dict(zip(names, r)) for r in result.fetchall()], columns)


def test_greedy_dedupe_hashes_whole_texts(spark, tmp_path):
    opening = "the same opening line of forty characters and more: "
    texts = [opening + " ".join(f"{w}{i}" for i in range(80)) for w in ("alpha", "beta", "gamma")]
    texts.append(texts[0])
    docs = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.QUERIES["dedupe_greedy"](spark, str(tmp_path)).collect()
    assert sorted(r.reason for r in got if r.reason) == ["exact"] and len(got) == 4


def test_clips_of_equal_rank_come_in_the_order_of_rows(spark, tmp_path):
    """Many lines of one number in two files, the second the larger, which Spark reads first; some without a supplier."""
    folder, con = tmp_path / "lineitem.parquet", duckdb.connect()
    folder.mkdir()
    con.execute("SET threads = 1")
    for part, n in enumerate((500, 200_000)):
        con.execute(f"""COPY (SELECT i % 400 AS l_orderkey, i * 31 % 2000 AS l_partkey, CASE WHEN i % 7 > 0 THEN i * 17 % 100 END AS l_suppkey, CAST(i // 400 % 3 + 1 AS INTEGER) AS l_linenumber, (i % 50)::DOUBLE AS l_quantity,
        hash(i + {part}) % 10 / 400.0::DOUBLE AS l_discount FROM range({n}) t(i)) TO '{folder}/part-{part}.parquet' (ROW_GROUP_SIZE 2048)""")
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{folder}/*.parquet'")
    want = sorted(con.execute(catalog.ORACLE_SQL["clip_take_n"]).fetchall())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    try:
        found = catalog.QUERIES["clip_take_n"](spark, str(tmp_path))
        assert found.columns == ["index", "rank", "class", "outcome"] and sorted(map(tuple, found.collect())) == want
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_clip_budget_goes_by_arrival_among_equal_ranks(spark):
    taken = [("p", 1, 1, "EXACT_SCENE", "ok", size, arrived) for size, arrived in ((50, 2), (100, 1), (10, 3))]
    records = spark.createDataFrame(taken, "project string, index int, rank int, class string, outcome string, bytes int, arrived int")
    got = locate.take_clips(records, dataclasses.replace(DEFAULTS, clips_per_segment=2), 100, ("arrived",))
    assert [tuple(r) for r in got.collect()] == [("p", 1, 1, "EXACT_SCENE", "ok", 100)]
