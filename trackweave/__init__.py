"""Spark operators for 4-D aircraft trajectories."""
