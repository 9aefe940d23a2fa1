"""Streaming: intentionally empty.

The reference has no streams, watermarks, stream windows or state; its
documents state that polling with content tags is enough. The content tag is
``operators.aggregates.content_fingerprint`` and a product result can be kept
as a snapshot (``sources.snapshots``), so a poller compares tags instead of
holding a stream open. Nothing here is invented to fill the category.
"""
