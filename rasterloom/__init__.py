"""rasterloom: raster-region analytics as DataFrame -> DataFrame operators on Spark."""
