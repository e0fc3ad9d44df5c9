"""Spark analytics for a chat-based learning assistant.

Every operator takes DataFrames of all users at once (plus an explicit
``as_of`` time where the clock matters) and returns a DataFrame.
"""
