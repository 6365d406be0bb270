"""Operators over catalogs: chunking, near neighbours, matches, partitioning tools."""
