"""Florilege: finding, verifying, correcting and scoring quoted passages with PySpark."""
