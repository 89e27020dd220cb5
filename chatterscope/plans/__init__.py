"""plans of chatterscope."""
