"""Removal and relocation plans as tables (survey §2 K)."""
