"""chorus -- feedback analytics on Spark.

Reviews and forum posts are read into one DataFrame schema, cleaned,
de-duplicated, classified and reported with DataFrame/SQL plans.
"""

__version__ = "0.1.0"
