"""Column expressions and column-set changes; all of them are native, none shuffles."""
