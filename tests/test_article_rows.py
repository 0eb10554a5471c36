"""Rows of articles leave a worker in pieces."""

from attestry.operators import articles


def test_rows_leave_in_pieces(spark):
    import pyspark.sql.functions as F

    texts = spark.range(3).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 2, F.repeat(F.lit("x"), 3)).alias("text")).coalesce(1)

    def make(t):
        made = [0]
        for k in range(3 * articles.ROWS):
            made[0] += 1
            yield k, made[0]

    # A piece is handed on before the text's next rows are made, so all are there and in order.
    got = articles._rows(texts, ["doc_id"], "text", "seq int, made int", make)
    assert [r["seq"] for r in got.where("doc_id = 1").collect()] == list(range(3 * articles.ROWS)) and got.count() == 6 * articles.ROWS
