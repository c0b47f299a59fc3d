"""Graph, hierarchy, incremental and aggregation operators (DataFrame in, DataFrame out)."""
