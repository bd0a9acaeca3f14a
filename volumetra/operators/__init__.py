"""Relational operators over views, blocks, voxels, interest points, correspondences and links."""
