"""Operators for preparing training text at scale: filters, deduplication, mixing and tokenisation.

Each module holds one operator with its own general interface. ``queries`` applies each of them
to a whole table. Nothing else in the package imports this subpackage.
"""
