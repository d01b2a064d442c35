"""Graph operators: build, iterate, partition, measure, compare."""
