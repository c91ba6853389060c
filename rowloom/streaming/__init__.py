"""The same operators over streams."""

from rowloom.streaming.micro import each_batch, event_windows

__all__ = ["each_batch", "event_windows"]
