"""Readers and writers for run documents, statistics and result tables."""
