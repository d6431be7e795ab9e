from newsloom import schemas
from newsloom.streaming import incremental
from test_collection import letters
from test_pages import page


def test_new_pages_are_read_once(spark, rows, tmp_path):
    pages, out, state = (str(tmp_path / n) for n in ("pages", "out", "state"))

    def arrive(*found):
        spark.createDataFrame(found, schemas.PAGES).write.mode("append").parquet(pages)
        incremental.extract_new_pages(spark, pages, out, state).awaitTermination()
        return rows(spark.read.parquet(out).selectExpr("url", "cast(ok as boolean) as ok"))

    assert arrive(("/a", page()), ("/b", "<p>")) == [("/a", True), ("/b", False)]
    assert arrive(("/c", page(origins=""))) == [("/a", True), ("/b", False), ("/c", True)]
    incremental.extract_new_pages(spark, pages, out, state).awaitTermination()
    assert spark.read.parquet(out).count() == 3


def test_new_articles_are_scored_once(spark, rows, tmp_path):
    stored, out, state = (str(tmp_path / n) for n in ("articles", "out", "state"))
    row = (None,) * 7
    spark.createDataFrame([(1, *row[:6], "ggs"), (2, *row[:6], "ss")], schemas.ARTICLES).write.parquet(stored)
    for _ in range(2):
        incremental.score_new_articles(spark, stored, out, state, letters).awaitTermination()
    assert rows(spark.read.parquet(out)) == [(1, 1.0), (2, -1.0)]
