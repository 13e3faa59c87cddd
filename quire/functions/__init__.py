"""Column functions: paths, URIs, text shapes, roles.  All are Spark expressions unless they say otherwise."""
