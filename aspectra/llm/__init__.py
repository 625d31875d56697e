"""Training-data operators: text preparation, filtering, near duplicates and retrieval.

Nothing else in the library imports this subpackage.
"""
