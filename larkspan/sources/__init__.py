"""Readers and writers of entity-linking file formats. Paths go to Spark's own readers, so any store works."""
