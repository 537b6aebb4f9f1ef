"""Windowed and stateful jobs; each gives the same rows in batch."""
