"""Entity linking and text analytics as lazy Spark plans."""
