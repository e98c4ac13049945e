"""rostra: a PySpark-native analytics engine for dated collections of transcribed speech."""
