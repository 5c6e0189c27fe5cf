"""Analytics over the history of code reviews, as functions from DataFrame to DataFrame."""
