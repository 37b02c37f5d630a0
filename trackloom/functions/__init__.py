"""Part of trackloom."""
