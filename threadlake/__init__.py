"""threadlake: a Spark-native engine for conversation analytics.

Subpackages: ``sources`` (scans and sinks), ``functions`` (column expressions),
``operators`` (DataFrame to DataFrame), ``plans`` (pipelines and named queries)
and ``streaming``.
"""
