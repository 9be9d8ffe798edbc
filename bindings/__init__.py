"""Registered queries: every operator bound to the given tables, with its SQL twin."""
