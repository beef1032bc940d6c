"""Data-processing operators over readings and samples."""
