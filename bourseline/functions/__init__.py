"""Column functions: text rules, identifiers, market rules."""
