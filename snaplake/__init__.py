"""Snapshot, session and event analytics as Spark DataFrame operators."""
