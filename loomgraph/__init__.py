"""Loomgraph: dependency-graph analytics expressed as Spark DataFrame plans."""
