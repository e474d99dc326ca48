"""Wildfire-ignition analytics as Spark jobs."""
