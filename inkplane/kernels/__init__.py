"""Pixel kernels on numpy arrays, for one sheet in one task. Masks are uint8, 0 and 255; points are (x, y), pixels [y, x]."""
