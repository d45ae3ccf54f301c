"""Spreadsheet-style analytics and training-data operators expressed as Spark jobs."""
