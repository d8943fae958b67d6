"""Sources, sinks and keyed storage of daily bars."""
