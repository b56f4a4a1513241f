"""paperledger: Spark jobs over tables of business documents and of training text."""
