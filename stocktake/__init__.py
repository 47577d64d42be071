"""Analytics over versioned, content-addressed file inventories, on Spark."""
