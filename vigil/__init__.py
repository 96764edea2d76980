"""vigil: Spark-native risk analytics on many daily price series at once.

Layout
------
sources/    readers for landed tables and the derived price / index panels
functions/  column-expression helpers (safe division, warm-up gates, clips)
operators/  DataFrame -> DataFrame operators (features, scoring, stocks,
            evaluation, detectors, export)
plans/      compositions of operators and the query registry

Every operator takes and returns a DataFrame and is keyed by ``universe``
(and ``symbol`` for per-symbol series), so the work partitions by series.
"""

from vigil.session import build_session, checkpoint_dir

__all__ = ["build_session", "checkpoint_dir"]
