"""Operators for training-data pipelines on top of the engine; nothing outside this folder needs them."""
