"""noteforge: a PySpark-native engine for multimodal note retrieval and corpus processing."""
