"""Analytics over large collections of atomic structures and grouped point data, on Spark."""
