"""tidewell: a Spark-first engine for evidence-grounded text analytics.

Operators take and return DataFrames; nothing runs until the caller acts.
"""
