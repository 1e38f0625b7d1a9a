"""placeweave: entity resolution of places, addresses and names as lazy Spark plans."""

__version__ = "0.1.0"
