"""Relational operators that Spark doesn't have as a built-in."""
