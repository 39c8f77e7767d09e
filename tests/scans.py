"""What the scans of a run read, from Spark's own metrics of finished executions."""

from __future__ import annotations

ROWS, SCAN = "number of output rows", "Scan "


def _seq(seq):
    return [seq.apply(i) for i in range(seq.size())]


def _executions(spark) -> dict[int, object]:
    store = spark._jsparkSession.sharedState().statusStore()
    return {e.executionId(): e for e in _seq(store.executionsList())}


def scans_of(spark, run) -> list[tuple[str, int]]:
    """(scan, rows) of every file scan that ``run()`` executes, streaming scans included."""
    bus = spark.sparkContext._jsc.sc().listenerBus()
    bus.waitUntilEmpty()
    known = set(_executions(spark))
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")  # whole locations
    try:
        run()
    finally:
        spark.conf.unset("spark.sql.maxMetadataStringLength")
    bus.waitUntilEmpty()
    store, found = spark._jsparkSession.sharedState().statusStore(), []
    for number in sorted(set(_executions(spark)) - known):
        metrics = store.executionMetrics(number)
        for node in _seq(store.planGraph(number).allNodes().toSeq()):
            if not node.name().startswith(SCAN):
                continue
            for metric in _seq(node.metrics().toSeq()):
                value = metrics.get(metric.accumulatorId())
                if metric.name() == ROWS and value.isDefined():
                    found.append((node.desc(), int(value.get().replace(",", ""))))
    return found
