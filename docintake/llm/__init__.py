"""Training-data operators over large text corpora. Nothing else in the library imports this subpackage."""
