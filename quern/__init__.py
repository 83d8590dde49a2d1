"""quern: DataFrame operators for semi-structured text at scale, built on PySpark."""
