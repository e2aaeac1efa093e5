"""Analytics over versioned documents on PySpark."""
