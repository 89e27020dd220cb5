"""functions of chatterscope."""
