"""Training-data operators: each module holds one operator, its contract query and, where SQL can say it, its SQL."""
