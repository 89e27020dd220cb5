"""operators of chatterscope."""
