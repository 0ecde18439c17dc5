"""Readers and the mapping of the sample tables to the shop schema."""
