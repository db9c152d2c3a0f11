"""The registered queries, on the driver's tables."""
