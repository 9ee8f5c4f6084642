"""Readers of the tables and the inputs derived from them."""
