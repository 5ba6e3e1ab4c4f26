"""Graph, retrieval, maintenance and evaluation operators."""
