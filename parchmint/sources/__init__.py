"""Readers of pages and structured documents into tables."""
