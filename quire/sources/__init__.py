"""Readers of the tables and file formats the engine works on."""
