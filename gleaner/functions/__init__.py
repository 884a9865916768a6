"""Package part; see the README for its contents."""
