"""shopflow: shop clickstream analytics as lazy Spark DataFrame operators.

Layers
------
sources/    scans and sinks (event CSV/parquet, feature tables, summary JSON,
            snapshot directories, the TPC-H fixture mapping)
functions/  Column-level kernels: interval labels, quantile bins, safe ratios,
            exact means, text helpers
operators/  DataFrame -> DataFrame operators: cleaning, feature tables,
            funnel / segmentation / temporal / product / revenue / behaviour
            analyses, exploration filters, retention, report tables, and the
            skew-safe ordered-scan kernels they rely on
plans/      stage wiring: the materialising context, the batch pipeline,
            the nested summary, the named query catalog and its SQL oracle
streaming/  incremental ingest of event files into the cleaned table
"""

__version__ = "0.1.0"
