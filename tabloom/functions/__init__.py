"""Column functions: text keys, numbers, dates and currencies."""
