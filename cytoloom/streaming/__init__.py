"""Incremental work.

The data model has no event streams: no watermarks, windows or state. What is
incremental is resuming a long computation, unit by unit (``resume``).
"""
