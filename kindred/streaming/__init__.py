"""Progress of running tasks, as a stream and as a batch."""
