"""Relational operators of rule mining: partitions, itemsets, rule counts, scores, metrics."""
