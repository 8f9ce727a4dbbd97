"""pixelframe: image-collection analytics as ordinary Spark DataFrame queries."""

__version__ = "0.1.0"
