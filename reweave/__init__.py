"""Measure how building blocks are reused across graph-shaped and textual data, on Spark."""
