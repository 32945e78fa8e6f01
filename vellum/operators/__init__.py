"""Relational operators over notes and chunks."""
