"""Operators for preparing training text at scale.

Nothing else in cytoloom imports this subpackage; it can be removed whole.
"""
