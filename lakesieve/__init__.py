"""lakesieve: auditing, searching and curating fine-tuning data on Spark."""
