"""Column functions: built on pyspark.sql.functions so that they stay inside generated code."""
