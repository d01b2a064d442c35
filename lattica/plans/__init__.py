"""The query catalogue: each operator applied to the graphs that lie in the order tables, with its SQL."""
