"""Streaming of trackloom."""
