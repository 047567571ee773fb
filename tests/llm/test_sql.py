"""The SQL of corpus queries against the queries, on the test tables and on odd rows."""

import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from chronotext.llm import licenses, queries

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from test_queries import SF, rows  # noqa: E402

EVERY = queries.oracle_sql() | {"op6_license_scan": queries.licenses_sql()}


def both(spark, name, folder):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet{'' if folder == SF else '/*.parquet'}')")
    return queries.queries()[name](spark, folder).toPandas(), con.execute(EVERY[name]).df()


@pytest.mark.parametrize("name", sorted(EVERY))
def test_queries_equal_their_sql(spark, name):
    mine, other = both(spark, name, SF)
    assert sorted(mine.columns) == sorted(other.columns) and rows(mine) == rows(other)


@pytest.mark.parametrize("name", ["op4_quality_rules", "op6_license_scan", "op9_decontamination"])
def test_queries_equal_their_sql_on_odd_texts(spark, corpus, tmp_path, name):
    """License texts with and without their options, repeats of all lengths, short benchmark items with substitutions."""
    texts = [t for _, t in licenses.TEMPLATES] + ["mit license " * 30, "Apache\tLicense\x0bx", "a b c d e f g h i j k " * 9, "#|<>\n\n#|<>\n x\u2003y é ", "", None, "x" * 5000]
    plain = [(t or "").replace("[", " ").replace("]", " ").replace("{12}", "any one").replace("{8}", "some one").replace("{6}", "") for t in texts]
    docs = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate([*plain, None, texts[1], texts[3]])], "doc_id long, text string")
    corpus.select("doc_id", "text").where("length(text) < 1500").unionByName(docs).write.parquet(f"{tmp_path}/documents.parquet")
    items = corpus.where("doc_id % 25 = 3").select(F.col("doc_id").alias("item_id"), F.substring("text", 1, 90).alias("text"))
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    mine, other = both(spark, name, str(tmp_path))
    assert rows(mine) == rows(other) and len(mine) > 0
