"""Operators for training data at scale: deduplication, quality, decontamination, mixing, sharding,
URL filters and page extraction. Nothing else in the library imports this subpackage."""
