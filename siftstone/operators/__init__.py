"""Operators of the engine: tables in, tables out."""
