"""Check and bench queries over the given tables, with SQL for the same results."""
