"""Queries and annotation of versioned text corpora on Spark."""
