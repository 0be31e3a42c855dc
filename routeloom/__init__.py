"""Personalised multi-criteria routing on large graphs, as DataFrame operations."""
