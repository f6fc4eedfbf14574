"""Analytics over captures of programme pages, and operators for training data, on PySpark."""
