"""Reusable relational operators built from DataFrame primitives."""
