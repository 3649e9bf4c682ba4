"""Analytics over large collections of notes, written as Spark DataFrame plans."""
