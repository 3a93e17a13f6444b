"""Analytics over drawings and their object tables, declared as Spark plans."""
