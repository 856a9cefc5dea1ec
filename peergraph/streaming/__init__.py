"""No streaming operators: the analysis is of one snapshot."""
