"""Spherical catalog analytics on Spark."""
