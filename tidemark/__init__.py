"""Cohort analytics and training-data pipelines on Spark DataFrames."""
