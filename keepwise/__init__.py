"""keepwise: customer retention and recurring-revenue analytics on Spark."""
