"""Whole jobs: detection over tables, and applying the chosen actions."""
