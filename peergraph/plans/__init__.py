"""The analysis as a whole: model, queries, exports, report."""
