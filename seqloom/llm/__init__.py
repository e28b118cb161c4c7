"""Operators on texts: token ids, container packing and personal items. Nothing else in the library imports this package."""
