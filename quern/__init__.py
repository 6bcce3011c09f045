"""Full-text retrieval, change-log and telemetry operators on Spark DataFrames."""
