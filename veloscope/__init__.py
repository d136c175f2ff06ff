"""veloscope: transaction-risk analytics on Spark (features, quality, scoring,
evaluation, drift, monitoring, backtests, registry tables, streaming)."""

__version__ = "0.1.0"
