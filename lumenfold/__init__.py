"""Lumenfold: profiling, comparison, integration, retrieval and audit operators on Spark DataFrames."""
