"""Replay of events in time order and serving of features as of any instant."""
