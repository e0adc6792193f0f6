"""Spark-native analytics for measured plans, planar geometry and triangle meshes."""
