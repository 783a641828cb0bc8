"""The query catalogue: every operator on the driver tables, with SQL to check it against."""
