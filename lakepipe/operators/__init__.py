"""Relational operators over Spark frames."""
