"""Column functions: keys, text, images, and the per-row HTML helper."""
