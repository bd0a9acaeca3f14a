"""Numeric kernels on numpy arrays: what one task computes for one block, pair or view. All follow published methods."""
