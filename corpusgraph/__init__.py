"""Corpus graph analytics on Spark: anchored property graph, retrieval and corpus operators."""
