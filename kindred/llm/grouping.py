"""Pairwise matches consolidated into groups by low-diameter decomposition.

Every vertex draws an exponential shift; clusters grow from vertices in the order of their shifted start times,
one hop a round. After a fixed number of rounds a last expansion is free of charge, so that no vertex with a
neighbour stays alone. Clusters contract to super-vertices, the edges between them are the next level's graph,
and the assignments of all levels are composed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.graph import contract_components, smallest_labels, uniform
from kindred.session import Scratch


def match_groups(edges: DataFrame, scratch: Scratch | None = None, rate: float = 0.5, growth: int = 2, seed: int = 7) -> DataFrame:
    """(node, group) for every node of ``edges`` (src, dst); group is the component's smallest node.

    ``rate`` is that of the exponential shifts (small: larger clusters), ``growth`` the rounds before the free
    expansion. Edges with a null end are left out; loops keep their node as a group of one; repeated edges count
    once; an empty table gives an empty one. Extra columns are ignored.
    """
    scratch = scratch or Scratch(edges.sparkSession)
    shifted = lambda node, level: F.log(uniform(node, level, seed)) / F.lit(rate)  # noqa: E731  # minus the shift
    roots = contract_components(edges, scratch, shifted, [1.0] * growth + [0.0])
    return smallest_labels(roots, scratch)
