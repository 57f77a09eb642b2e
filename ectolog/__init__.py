"""Biologging and thermal-ecology analytics as Spark DataFrame operators."""
