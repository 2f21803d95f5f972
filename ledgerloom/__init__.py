"""Spark-native ledger inference and corpus analytics."""
