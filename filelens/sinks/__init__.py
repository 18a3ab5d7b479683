"""Outputs: report tables and the stored inventory (survey §2 B)."""
