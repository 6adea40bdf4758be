"""Operators for training-data pipelines. Nothing else in kindred imports this subpackage."""
