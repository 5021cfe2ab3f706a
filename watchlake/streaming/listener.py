"""Per-micro-batch counters from running streams."""

from pyspark.sql.streaming import StreamingQueryListener


class QualityListener(StreamingQueryListener):
    """Sums the counters that ``operators.quality.observed`` attached to a stream."""

    def __init__(self, counters: str = "silver_quality"):
        self.counters = counters
        self.totals: dict[str, int] = {}
        self.batches = 0

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        row = event.progress.observedMetrics.get(self.counters)
        if row is None:
            return
        self.batches += 1
        for outcome, n in row.asDict().items():
            self.totals[outcome] = self.totals.get(outcome, 0) + n

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass
