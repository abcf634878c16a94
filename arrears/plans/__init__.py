"""Composed datasets: facts, dimensions, KPIs, marts and quality reports.

Every public function is ``f(src, params) -> DataFrame`` and lazy.
"""
