"""A PySpark-native analytics engine for episodic robot-demonstration data."""
