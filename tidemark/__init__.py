"""A keyed-changelog engine on Spark."""
