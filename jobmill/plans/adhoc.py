"""Ad-hoc SQL over named tables."""

from pyspark.sql import DataFrame, Row, SparkSession


def run_sql(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """A query over the given tables, bound as temporary views of these names."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)


def preview(df: DataFrame, rows: int = 10) -> tuple[list[Row], bool]:
    """The first rows, and whether there are more."""
    got = df.limit(rows + 1).collect()
    return got[:rows], len(got) > rows


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)
