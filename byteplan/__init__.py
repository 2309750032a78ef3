"""PySpark-native analysis and lossless encoding of collections of byte blobs."""
