"""The data model on the given tables, and the registered queries."""
