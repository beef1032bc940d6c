"""Column functions on dynamically typed values, histograms and names."""
