"""Cross-sectional factor research on Spark DataFrames."""
