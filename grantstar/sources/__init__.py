"""Readers: delimited raw feeds, stored stars and the benchmark tables."""
