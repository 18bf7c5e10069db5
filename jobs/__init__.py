"""Runnable jobs: each is a function that takes a session, with a command line and a configuration file beside it."""
