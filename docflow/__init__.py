"""Spark jobs that turn large collections of documents into section trees, work items and reviewable tables."""
