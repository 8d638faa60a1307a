"""Relational operators: hierarchies, wide tables, canned graph analytics."""
