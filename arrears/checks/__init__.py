"""Correctness checks: the SQL oracle and a result comparator."""
