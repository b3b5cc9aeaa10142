"""DataFrame operators: manifest, recognition, splits, segments, sampling, features, windows, metrics."""
