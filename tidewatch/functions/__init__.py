"""Column functions of the risk engine."""
