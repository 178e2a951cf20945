from flowfeat.sources import readers, writers

__all__ = ["readers", "writers"]
