"""Tables, files and archives as DataFrames, and back."""
