"""Every registered query of the library against its SQL, over the smallest tables."""

import glob
import os

import duckdb
import pytest

from foliolens import queries as own

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def normal(df):
    df = df[sorted(df.columns)].copy()
    for c in df:
        if "datetime" in str(df[c].dtype):
            df[c] = df[c].astype(str).str[:10]
    return df.astype(str).replace({"NaT": "None", "nan": "None", "<NA>": "None"}).sort_values(list(df.columns)).reset_index(drop=True)


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", own.queries())
def test_query(spark, sql, name):
    got, want = normal(own.queries()[name](spark, SF).toPandas()), normal(sql.sql(own.oracle_sql()[name]).df())
    assert list(got.columns) == list(want.columns) and len(got) == len(want) and got.equals(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).limit(5).count() == 5 and set(entry.oracle_sql()) <= set(entry.queries())


def test_free_text_of_any_amount(spark, sql, tmp_path):
    """Runs of digits whose cents do not fit a BIGINT, and null and empty texts, against the SQL."""
    texts = [None, "", "none", "5", "-7 R$", "9" * 16, "92233720368547759", "password=x99895542219563132x", "9" * 25, "a,b ٣", "R$ 1.234,56"]
    made = str(tmp_path / "documents.parquet")
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(made)
    build, statement = own.queries()["free_text_ids"], own.oracle_sql()["free_text_ids"]
    want = sql.sql(f"WITH documents AS (SELECT * FROM '{made}/*.parquet') {statement}").df()
    assert normal(build(spark, str(tmp_path)).toPandas()).equals(normal(want))
