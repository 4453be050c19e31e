"""Pages that the given tables don't hold."""

import duckdb
from pyspark.sql import functions as F

from quillspark.plans import catalogue

ODD = [(1, None), (2, ""), (3, "<title> A &amp;\n b</title><body><p>c</p></body>"), (4, '<body><a href="https://e.org/x">x</a></body>'), (5, "<title>A &amp</title>")]


def test_a_page_without_markup_has_no_metadata(spark, tmp_path):
    rows = spark.createDataFrame(ODD, "page_id long, html string")
    rows.withColumn("url", F.lit("u")).write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(tuple(r) for r in catalogue.QUERIES["html_metadata"](spark, str(tmp_path)).select("page_id", "title", "links", "urls").collect())
    duck = duckdb.connect()
    duck.sql(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert got == sorted(duck.sql(f"select page_id, title, links, urls from ({catalogue.ORACLE['html_metadata']})").fetchall())
    assert got == [(1, None, None, None), (2, "", 0, ""), (3, "A & b", 0, ""), (4, "", 1, "https://e.org/x"), (5, "A &", 0, "")]
