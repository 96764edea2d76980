"""Physical-plan shape: pruned scans, pushed filters, no pair blow-ups."""

import pytest

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_orders_scan_is_pruned(spark):
    from vigil.sources import panels
    plan = _plan(panels.region_daily(spark, SF))
    scans = [ln for ln in plan.splitlines() if "orders.parquet" in ln or "FileScan" in ln]
    orders = [ln for ln in scans if "o_totalprice" in ln]
    assert orders, plan
    for ln in orders:
        assert "o_orderstatus" not in ln and "o_orderpriority" not in ln


def test_date_filter_is_pushed_into_the_scan(spark, tmp_path):
    from vigil.sources import files, panels
    path = str(tmp_path / "prices")
    files.write_table(panels.prices_panel(spark, SF).select(
        *[f.name for f in files.PRICE_SCHEMA.fields]), path)
    df = files.read_prices(spark, path, start="1996-01-01", end="1997-01-01")
    plan = _plan(df)
    assert "PushedFilters" in plan and "date" in plan.split("PushedFilters")[1][:300]


def test_orders_and_line_items_are_scanned_once(spark, monkeypatch):
    """The whole feature plan, but for its last write, from the raw tables."""
    from vigil.plans import frames
    scanned = []
    plain = frames.cut_lineage
    monkeypatch.setattr(frames, "cut_lineage", lambda df: (scanned.append(_plan(df)), plain(df))[1])
    scanned.append(_plan(frames.features(spark, SF, materialize=False)))
    whole = "\n".join(scanned)
    assert whole.count("o_orderdate") and sum("orders.parquet" in ln and "Location" in ln
                                              for ln in whole.splitlines()) == 1
    assert sum("lineitem.parquet" in ln and "Location" in ln for ln in whole.splitlines()) == 1


@pytest.mark.parametrize("build", ["features", "symbol_returns"])
def test_no_cartesian_or_nested_loop_join(spark, build):
    from vigil.plans import frames
    how = {"materialize": False} if build == "features" else {}
    df = getattr(frames, build)(spark, SF, **how)
    plan = df._jdf.queryExecution().optimizedPlan().toString() + _plan(df)
    assert "Window" in plan and "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["cross_symbol_corr", "stock_features", "aligned_panel", "market_features", "risk_scores",
                                  "stock_analysis", "dashboard_document", "segmented_features"])
def test_every_feature_query_scans_orders_once(spark, monkeypatch, name):
    """All frames a query writes and the one it returns read the raw orders once in all."""
    import __spark_entry__ as entry
    from vigil import session
    seen = []

    def count(df):
        return sum("orders.parquet" in ln and "Location" in ln for ln in _plan(df).splitlines())

    plain = session.cut_lineage
    written = lambda df: (seen.append(count(df)), plain(df))[1]
    import sys
    for module in [m for k, m in sys.modules.items() if k.startswith("vigil.") and not k.startswith("vigil.llm")]:
        if getattr(module, "cut_lineage", None) is plain:
            monkeypatch.setattr(module, "cut_lineage", written)
    seen.append(count(entry.queries()[name](spark, "/root/testdata/sf0.01")))
    assert sum(seen) == 1
