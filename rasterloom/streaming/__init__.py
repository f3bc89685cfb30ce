"""Arriving images: a stream of files, each traced once by the batch plan."""
