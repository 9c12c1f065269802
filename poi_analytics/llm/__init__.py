"""Training-data operators: archives, deduplication, language ID, token counts, packing, scoring.

Nothing else in the library imports this subpackage.
"""
