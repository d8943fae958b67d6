"""Query plans of the risk engine."""
