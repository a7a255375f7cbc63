"""Operators for preparing training text at scale, their queries and their SQL.

Nothing else in the library imports this package.
"""
