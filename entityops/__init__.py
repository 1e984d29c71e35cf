"""Entity operations on Spark: rules, matching, adjudication, resolution, audit and usage."""
