"""Relational operators of the virtual-detector workload."""
