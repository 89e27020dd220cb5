"""streaming of chatterscope."""
