"""Operators for training-data pipelines. Nothing else in evq imports this subpackage."""
