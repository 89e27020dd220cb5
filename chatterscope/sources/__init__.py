"""sources of chatterscope."""
