from .export import export_view, write_export

__all__ = ["export_view", "write_export"]
