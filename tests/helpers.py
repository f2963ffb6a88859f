from pyspark.sql import functions as F


def values(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def column(df, c):
    """Values of one expression in row order."""
    return [r[0] for r in df.select(c.alias("c")).collect()]


def posting_rows(spark, rows):
    """Rows of (title, company, url, description, kind, batch_seq, pos)."""
    df = spark.createDataFrame(
        rows, "title string, company string, url string, description string, kind string, batch_seq int, pos long"
    )
    return df.select(
        "title", "company", "url", "description",
        F.lit("").alias("salary"), F.col("kind").alias("source"), F.lit("").alias("posted"), "batch_seq", "pos", "kind",
    )
