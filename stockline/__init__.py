"""stockline: inventory and marketplace analytics as PySpark DataFrame jobs.

Operators are plain functions ``DataFrame(s) + parameters -> DataFrame``; the
clock is always the parameter ``as_of``.
"""
