"""Column functions: reductions, segment cost model, directions."""
