"""codestrata: a PySpark-native engine for code-edit history.

Retrieval, churn analytics, change classification, chunking, language
detection and code graphs, all as DataFrame -> DataFrame operators.
"""
