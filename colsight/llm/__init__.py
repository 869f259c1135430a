"""Operators for preparing training text, one module each; their registered queries are in ``catalog``."""
