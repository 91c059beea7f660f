"""Audit, linkage and estimation operators over Spark DataFrames."""
