"""Relational and iterative operators on populations."""
