"""The registered queries: shop tables derived from the test tables, and for
each query its Spark form and the equivalent SQL."""
