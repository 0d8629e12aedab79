"""Record-level comparison and regression testing of tables, on Spark DataFrames."""
