"""Where documents, detector answers and scanned tables come from."""
