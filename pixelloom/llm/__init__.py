"""Operators for training-data pipelines over ``documents``, ``embeddings`` and ``pages``.

Nothing else in the library imports this subpackage.
"""
