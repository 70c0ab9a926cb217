"""Whole workflows, and the registered queries over the driver tables."""
