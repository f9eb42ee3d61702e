"""Readers: survey tables with their labels, word lists, stop words, places and names."""
