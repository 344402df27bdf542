"""Corpus curation and audit engine expressed as Spark DataFrame programs."""
