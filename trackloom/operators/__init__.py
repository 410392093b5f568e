"""Operators of trackloom."""
