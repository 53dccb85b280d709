"""Jobs that a scheduler runs: each has a function that takes a session, a command line and a small config file."""
