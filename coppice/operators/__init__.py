"""The relational operators of boosting: binning, histograms, splits, routing, sampling, encoding."""
