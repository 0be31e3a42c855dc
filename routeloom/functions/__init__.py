"""Column expressions: cost vectors, partition algebra, geometry."""

from .geometry import GridBounds, cell_id, grid_index, haversine_km
from .partition import all_partition_ids, differing_level, partition_id
from .vectors import dominates, dot, normalise_preference, vector_add

__all__ = ["GridBounds", "all_partition_ids", "cell_id", "differing_level", "dominates", "dot", "grid_index", "haversine_km", "normalise_preference", "partition_id", "vector_add"]
