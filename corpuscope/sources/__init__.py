"""Readers, writers and the syntax-tree adapter."""
