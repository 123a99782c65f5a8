"""Whole queries over the driver's tables, and the SQL that has the same result."""
