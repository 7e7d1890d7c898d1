"""Retrieval, evidence and ledger analytics on Spark DataFrames."""
