"""Relational operators over bibliographic tables."""
