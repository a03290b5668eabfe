"""The queries of the library by name, and the SQL that gives the same rows."""
