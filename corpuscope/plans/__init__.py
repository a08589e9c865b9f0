"""Bindings of the operators to tables, the query catalog and the whole-report plan."""
