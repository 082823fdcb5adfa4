"""Relational, retrieval, graph and quality operators."""
