"""DataFrame operators: repetition filter, capped filtering and sampling,
scoring, budget assembly and the statistics reports.
"""
