"""Queries over the driver's tables, each with the SQL that it must agree with, and composite pipelines."""
