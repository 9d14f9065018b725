"""Scalar functions of the engine; each takes and gives columns."""
