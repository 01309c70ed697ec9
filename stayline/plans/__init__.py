"""Bindings of the driver tables to panels, and the registered queries."""
