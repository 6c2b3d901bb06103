"""Analytics over corpora of source repositories, as Spark jobs over tables."""
