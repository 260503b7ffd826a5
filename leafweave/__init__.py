"""Leafweave: document structure analytics as Spark DataFrame operators."""
