"""Spark-native document and execution-ledger analytics."""
