"""Operators over training-data tables: one module per operator, their registered queries in `queries`."""
