"""A Spark-native web-text search and analytics engine.

Every operator is a function of DataFrames or Columns; network effects are input
tables.  The subpackage ``llm`` is optional and imported by nothing else here.
"""
