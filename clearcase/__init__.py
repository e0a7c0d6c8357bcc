"""Prior-authorization analytics as Spark jobs: DataFrame in, DataFrame out."""
