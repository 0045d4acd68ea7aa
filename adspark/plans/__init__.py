"""Registered queries over the driver's tables, each with its SQL twin where one exists."""
