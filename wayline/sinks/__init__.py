"""Writers: append, replace, swap, publish."""
