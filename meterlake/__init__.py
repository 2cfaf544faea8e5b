"""Analytics over metric points on Spark."""
