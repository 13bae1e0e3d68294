"""Spark-native integration of single-cell panels, plus corpus operators in :mod:`cytoloom.llm`."""
