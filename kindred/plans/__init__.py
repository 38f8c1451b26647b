"""The registered queries, each with SQL for the same rows where SQL can express it."""
