"""Registered queries over the driver tables, each beside its SQL oracle where one exists."""
