"""Operators for preparing large training corpora.

Every operator is a function from DataFrames to a DataFrame.  Rows are never
capped or sampled to dodge skew; hot keys are pre-aggregated, salted or dealt
into blocks.  State that several plans share is cut with ``checkpoint()`` or a
table in the folder that ``spark.checkpoint.dir`` names.
"""
