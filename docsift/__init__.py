"""docsift: semantic document search expressed as Spark DataFrame plans.

Every public operator takes DataFrames and returns a DataFrame; nothing is
collected to the driver except bounded query blocks and centroids.
"""

__version__ = "0.1.0"
