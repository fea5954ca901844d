"""Longitudinal panels and posterior-draw tables as Spark DataFrame jobs."""
