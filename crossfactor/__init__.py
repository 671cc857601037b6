"""Daily cross-sectional factor analysis of (date, ticker) panels on Spark."""
