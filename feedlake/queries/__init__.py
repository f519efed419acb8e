"""One query per operator over the given tables, each with its SQL counterpart."""
