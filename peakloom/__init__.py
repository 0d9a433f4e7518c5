"""Spectral peak queries, corpora, topic models and motif analytics on Spark."""
