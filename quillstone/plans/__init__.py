"""Named queries, each with the SQL that states its result where SQL can."""
