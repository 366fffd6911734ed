"""Spark-native analysis of multichannel biosignal time series."""
