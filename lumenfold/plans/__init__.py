"""The registered queries: each operator on the test tables, with the SQL that should give the same rows."""
