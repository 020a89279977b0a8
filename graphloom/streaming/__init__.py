"""Streams over the event table. An extension of our own: analysis in windows of event time, with late data dropped by watermark."""
