"""Readers and writers of graph, partition, query and result files, and graphs derived from tables."""
