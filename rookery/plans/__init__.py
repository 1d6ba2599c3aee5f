"""Models and reports."""
