"""citeweave: record linkage, verification and quality analytics for bibliographic records on Spark."""
