"""A PySpark-native analytics engine for batched particle systems, and operators for training corpora.

Particles, groups, systems, edges and trajectories are DataFrames linked by foreign keys; see the subpackages.
"""

__version__ = "0.1.0"
