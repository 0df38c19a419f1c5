"""DataFrame in, DataFrame out: scanning, filters, keyed changes and reports."""
