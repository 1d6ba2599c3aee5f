"""Rookery: game-archive analytics as Spark DataFrame jobs.

Sub-packages
------------
functions   column expressions (calendar, scoring, openings, move text, durations)
sources     landing tables, nested archives, seeds and sinks
operators   reusable DataFrame operators (dedupe, unpivot, streaks, merge, history)
plans       models and reports built from the operators
streaming   the daily job as an available-now stream
"""

__version__ = "0.1.0"
