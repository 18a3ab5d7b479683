"""filelens: file-inventory analytics on Spark (duplicates, profiles, hierarchy, relocation plans)."""

__version__ = "0.1.0"
