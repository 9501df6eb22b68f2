"""Image files as they arrive, converted page by page."""

from gridloom.streaming.pages import pages

__all__ = ["pages"]
