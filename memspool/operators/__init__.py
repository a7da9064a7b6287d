"""Relational operators on turns and memory nodes."""
