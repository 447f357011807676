"""Memory analytics and data pipelines on Spark DataFrames."""
