"""DataFrame operators: centroids, similarities, n-grams, neighbours, taxonomies, metrics, graphs, harvest and stores."""
