"""Column expressions and small dimension builders (schemas, calendar, lettering)."""
