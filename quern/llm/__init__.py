"""Training-data operators: cleaning, deduplicating, scanning, scoring and tokenising documents.

Nothing else in the library imports this subpackage. ``queries.py`` registers its queries.
"""
