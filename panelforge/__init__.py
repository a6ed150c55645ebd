"""Panel analytics as Spark jobs: sources, features, labels, metrics, decisions and streams."""
