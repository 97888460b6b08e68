"""Spark-native engine for retrieval, knowledge graphs, ranking evaluation and leakage audits."""
