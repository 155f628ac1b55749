"""Reading reviews, predictions and results; writing versioned tables and run logs."""
