"""Sequential image algorithms in numpy, one image (or region) at a time; `grids` runs them per image in Spark."""
