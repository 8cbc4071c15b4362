"""Operators for large-scale training-data pipelines. Nothing else in the engine imports this package."""
