"""siftworks: a PySpark-native engine for acquiring, cleaning and triaging posting-like text records."""
