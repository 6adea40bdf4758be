"""kindred: near-duplicate search and similarity analytics on PySpark DataFrames."""
