"""Corpus operators for training data: near-duplicates, line filters, quality, packing, search."""
