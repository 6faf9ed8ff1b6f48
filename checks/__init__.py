"""Every operator bound to the test tables, next to the SQL that gives the same result."""
