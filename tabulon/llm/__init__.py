"""Operators for preparing training text: counting, scoring, filtering,
de-duplicating, mixing, packing and rendering whole document tables.

Nothing else in the library imports this subpackage."""
