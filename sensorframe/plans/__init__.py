from .views import SeriesSpec, series_bundle, table_view

__all__ = ["SeriesSpec", "series_bundle", "table_view"]
