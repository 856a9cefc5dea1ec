"""Training-data operators on documents. Nothing else in the library imports this subpackage."""
