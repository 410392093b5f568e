"""Plans of trackloom."""
