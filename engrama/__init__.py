"""engrama: associative-memory analytics over text collections, planned by Spark."""
