"""Reading terms, pairs, matrices and harvested articles, and adapters for the test tables."""
