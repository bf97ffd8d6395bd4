"""Relational, segmentation, similarity, geometry and enrichment operators."""
