"""ruleloom: Spark-native similarity, graph and catalog analytics."""
