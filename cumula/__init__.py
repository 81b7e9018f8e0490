"""Gridded-weather analytics as Spark DataFrame functions."""
