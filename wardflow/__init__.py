"""Clinic-operations analytics as Spark DataFrame operators."""
