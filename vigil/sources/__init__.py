"""Sources: table readers, derived panels and file readers/writers."""

from vigil.sources.panels import (
    carried_closes,
    events_prices_panel,
    index_panel,
    macro_series,
    market_calendar,
    prices_panel,
    segment_orders,
    symbol_catalogue,
    symbol_returns,
)
from vigil.sources.tables import read_table

__all__ = [
    "carried_closes",
    "events_prices_panel",
    "index_panel",
    "macro_series",
    "market_calendar",
    "prices_panel",
    "read_table",
    "segment_orders",
    "symbol_catalogue",
    "symbol_returns",
]
