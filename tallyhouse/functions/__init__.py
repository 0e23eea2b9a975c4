"""Column expressions: the shop's scalar rules, all built from Spark built-ins."""
