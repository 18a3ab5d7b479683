"""Inputs: the folder-tree data sources and per-file content readers (survey §2 A)."""
