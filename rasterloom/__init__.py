"""rasterloom: JPEG-LS raster analytics and table processing on PySpark."""
