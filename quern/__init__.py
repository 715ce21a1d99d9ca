"""Quern: building and querying knowledge graphs of subject-predicate-object triples on Spark."""
