"""Functions of trackloom."""
