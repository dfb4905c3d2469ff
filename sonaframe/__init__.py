"""sonaframe: Spark-native preparation of speech and dialogue corpora.

Every operator takes and returns DataFrames and is built from Spark SQL
expressions, joins, aggregates and windows; Python runs inside tasks only
where an operator carries sequential state along one signal.
"""

__version__ = "0.1.0"
