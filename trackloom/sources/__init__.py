"""Sources of trackloom."""
