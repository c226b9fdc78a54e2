"""Workload-aware layout advisor and analytics operators on Spark."""
