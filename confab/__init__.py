"""Analytics over spoken-meeting data on Spark."""
