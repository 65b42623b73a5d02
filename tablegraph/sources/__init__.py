"""Readers: files in, tables with row positions out."""
