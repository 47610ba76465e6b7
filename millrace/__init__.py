"""Millrace: a Spark-native engine for document retrieval analytics.

Every operator takes and returns DataFrames; a batch of queries or documents
is the unit of work, and Catalyst chooses the physical plan.
"""
