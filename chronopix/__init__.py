"""chronopix: per-location time-series analytics on PySpark.

Sub-packages
------------
functions   Column builders and NumPy kernels (no Spark session needed)
sources     catalogue / raster / Parquet readers and writers
operators   DataFrame -> DataFrame operators (segmentation, maps, joins ...)
plans       multi-step jobs built from operators, and the query registry
streaming   Structured Streaming monitors and incremental maintenance
"""

__version__ = "0.1.0"
