"""Spark-native analytics over source trees: metrics, duplicate blocks, rule findings, snapshot comparison, policy gate."""
