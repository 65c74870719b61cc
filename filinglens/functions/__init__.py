"""Column functions: every one takes and gives Columns, so they compose inside one projection."""
