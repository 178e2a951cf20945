from flowfeat.functions import arrays, dates, hashing, scores

__all__ = ["arrays", "dates", "hashing", "scores"]
