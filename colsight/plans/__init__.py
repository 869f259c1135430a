"""Whole runs made of operators: diagnosis of a table, questions about it, and the query catalogue."""
