"""Spark-native analytics for protein-sequence, locus and protein-RNA structure tables."""
