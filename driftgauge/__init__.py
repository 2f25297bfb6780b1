"""Model-reliability analytics over scored events, as Spark DataFrame operators."""
