"""Spark-first analytics over listing snapshots: relational operators, features, splits and models."""
