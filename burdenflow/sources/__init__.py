"""Table readers and writers, schemas, constant tables, and the binding of the test tables."""
