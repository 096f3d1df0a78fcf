"""Pure Column expressions: no actions, no Python UDFs."""
