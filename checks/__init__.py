"""Queries for the driver, the views they read, and the same queries in SQL."""
