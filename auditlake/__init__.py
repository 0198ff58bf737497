"""Spark-first analytics over code graphs, findings, notes and documents."""
