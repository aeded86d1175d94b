"""A PySpark-native engine for selecting, scoring and compositing earth-observation scenes."""
