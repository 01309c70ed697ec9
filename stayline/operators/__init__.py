"""DataFrame -> DataFrame operators over a panel."""
