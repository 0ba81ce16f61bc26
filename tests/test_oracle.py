"""Every registered query of the page and contribution operators against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

from inkfold.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if hasattr(v, "asDict"):
        v = v.asDict()
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in sorted(v.items())) + "}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in values)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(registry.ORACLE))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, SF)
    want = duck.sql(registry.ORACLE[name])
    assert sorted(got.columns) == sorted(want.columns)
    values = rows(got.columns, got.collect())
    assert values == rows(want.columns, want.fetchall()) and values


@pytest.mark.parametrize("name", ["luma", "character_raster", "corner_patch", "crop_columns", "raster_signature"])
def test_documents_without_text_are_no_page(spark, tmp_path, name):
    """Null and empty texts among others: blanks, characters beyond 16 bits, a zero, and lengths about a row's."""
    texts = [None, "", " ", "a", "\0", "a\0b", "12345678", "123456789", "\U0010ffff" * 9, "e\u0301\r\n\t", "\u1019\u103c\u1014\u103a" * 20]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES[name](spark, str(tmp_path))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
        want = c.sql(registry.ORACLE[name])
        assert rows(got.columns, got.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE])
def test_other_queries_give_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).limit(1).count() == 1


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
