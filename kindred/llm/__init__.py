"""Training-data operators: one module for each, with its query; `queries` lists them."""
