"""Spark jobs for sparse-voxel point clouds, and (in ``llm``) for training text."""
