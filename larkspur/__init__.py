"""A batch analytics engine on Spark: typed CSV folders and Parquet tables, SQL files and DataFrame operators."""
