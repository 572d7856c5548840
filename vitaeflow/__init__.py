"""Analytics over résumés and corpora on Spark."""
