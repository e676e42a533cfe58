"""Subscriber-retention analytics as Spark DataFrame, SQL, MLlib and streaming plans."""
