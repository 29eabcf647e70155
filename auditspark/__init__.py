"""A Spark-native engine that audits collections of agent-skill packages."""
