"""Jobs that run by themselves: a function that takes a session, and a command line around it."""
