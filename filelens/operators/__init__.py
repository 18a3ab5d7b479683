"""Relational operators over inventories: duplicates, statistics, filters, hierarchy, ranking."""
