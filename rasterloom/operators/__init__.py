"""Operators: DataFrame -> DataFrame, keyed by image_id (and label)."""
