"""Operators for training-data pipelines: de-duplication, filtering, packing, encoding, retrieval and archiving."""
