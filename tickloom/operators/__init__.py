"""DataFrame-to-DataFrame operators over ticks, panels and daily context tables."""
