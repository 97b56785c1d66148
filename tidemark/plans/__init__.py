"""Which input is new: batches, their logs and their planners."""
