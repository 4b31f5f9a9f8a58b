"""Training-data operators: deduplication, quality, extraction, formatting, mixing.

Nothing else in the library imports this subpackage. Each module holds one
operator; ``queries`` registers one query per operator with its oracle SQL.
"""
