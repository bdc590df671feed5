"""Where raw messages and readings come from and go to."""
