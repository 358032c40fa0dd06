"""Plans over the operators: the sampling fixpoint and the registered queries with their SQL."""
