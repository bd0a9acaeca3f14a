"""volumetra: registration and fusion of overlapping 3-D image tiles as Spark DataFrame plans."""
