"""foliograph: a Spark-native engine for document evidence and document-scale data preparation.

Every operator is a function from DataFrames to DataFrames. Relations are keyed by ``doc_id``
(and ``page`` where geometry matters), so the planner can keep one partitioning through a chain.
"""
