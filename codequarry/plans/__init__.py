"""Whole reports assembled from the operators."""
