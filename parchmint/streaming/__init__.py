"""Event streams: windows, sessions, repeats and refreshes (an extension beyond the batch operators)."""
