"""Named queries over the given tables, each with its SQL oracle where SQL can say it."""
