"""Trajectory and text-corpus analytics written with the Spark DataFrame and SQL API."""
